import re

from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import words

CJK = "々-〇぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ"
PLAIN = re.compile(f"[{CJK}]|[^\\W_{CJK}]+")
TEXTS = st.lists(st.text(alphabet="abAB zé_.,12中日カー\n-ßЯ", max_size=40), max_size=6)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_are_those_of_a_plain_scan(texts):
    w = words.words(texts)
    found = [[] for _ in texts]
    for r, a, b in zip(w.row, w.start, w.end, strict=True):
        found[r].append(texts[r][a:b])
    assert found == [PLAIN.findall(x) for x in texts]
    seen = {}
    for r, a, b, h in zip(w.row, w.start, w.end, w.hash, strict=True):
        assert seen.setdefault(texts[r][a:b].lower(), h) == h
    assert len(set(seen.values())) == len(seen)


def test_digit_runs_are_equal():
    w = words.words(["a1b 22 7 a999b"], digits_equal=True)
    assert w.hash[0] == w.hash[3] and w.hash[1] == w.hash[2] and w.hash[0] != w.hash[1]


def test_runs_stay_in_their_text():
    w = words.words(["a b c", "d", "", "e f"])
    _, at = words.runs(w.row, w.hash, 2)
    assert at.tolist() == [0, 1, 4]
    assert list(words.chunks(["aa", "b", "cccc"], most=3)) == [(0, 2), (2, 3)]
