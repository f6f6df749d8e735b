import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm.sentences import sentences, split_sentences

CASES = {
    "See Fig. 2 and Sec. 3.4 for it. It holds.": ["See Fig. 2 and Sec. 3.4 for it.", "It holds."],
    'The manual says "Stop it. Wait 5 s. Restart." and we agreed. Really?! Yes': ['The manual says "Stop it. Wait 5 s. Restart." and we agreed.', "Really?!", "Yes"],
    'The answer was "It is local." A dose is usual.': ['The answer was "It is local."', "A dose is usual."],
    '"Why is it slow?" asked the clinic. "Why is it lazy?" asked our team.': ['"Why is it slow?" asked the clinic.', '"Why is it lazy?" asked our team.'],
    "Dr. Vexa came at 3 p.m. The visit, i.e. the test, took etc. Then it ended.": ["Dr. Vexa came at 3 p.m.", "The visit, i.e. the test, took etc.", "Then it ended."],
    "We waited... and then it came. It ends in 9. split_queue returns None.": ["We waited... and then it came.", "It ends in 9.", "split_queue returns None."],
    "It appears.Use a dictionary. Open a.tar.gz and `x.y()` near 3.": ["It appears.Use a dictionary.".split(".Use")[0] + ".", "Use a dictionary.", "Open a.tar.gz and `x.y()` near 3."],
    "Am 3. Mai stieg es, z. B. hier. Laut Abb. 5 gut.": ["Am 3. Mai stieg es, z. B. hier.", "Laut Abb. 5 gut."],
    "Im Buch steht „Bitte warten. Nicht gehen.“, und so blieb es an. Ende.": ["Im Buch steht „Bitte warten. Nicht gehen.“, und so blieb es an.", "Ende."],
    "Le guide dit « Attendez. Ne coupez rien. » et la table reste. Fin.": ["Le guide dit « Attendez. Ne coupez rien. » et la table reste.", "Fin."],
    "手册写着“请等待。不要关机。”，所以运行。医生问：“多久了？”最后，停止！": ["手册写着“请等待。不要关机。”，所以运行。", "医生问：“多久了？”", "最后，停止！"],
    "打开a.js……然后继续。好。": ["打开a.js……然后继续。", "好。"],
    "説明書には「待って。切らないで。」と書いてあり、動く。遅い！": ["説明書には「待って。切らないで。」と書いてあり、動く。", "遅い！"],
    'लिखा है "रुकें। बंद न करें।" और चलता रहा। डॉ. Vaf ने 2.5 मि.ग्रा. दिया।': ['लिखा है "रुकें। बंद न करें।" और चलता रहा।', "डॉ. Vaf ने 2.5 मि.ग्रा. दिया।"],
    "เราตรวจสอบก่อนเสมอ ดร. Gna ตรวจเวลา 19.30 น. แล้ว ต้องใช้หรือไม่? จบ": ["เราตรวจสอบก่อนเสมอ", "ดร. Gna ตรวจเวลา 19.30 น. แล้ว", "ต้องใช้หรือไม่?", "จบ"],
    "هل نحتاج إلى الصف؟ كتب د. Weg أن السجل مستقر. انتهى.": ["هل نحتاج إلى الصف؟", "كتب د. Weg أن السجل مستقر.", "انتهى."],
    "В 2021 г. врач назначил т. е. модуль и др. поля. Конец.": ["В 2021 г. врач назначил т. е. модуль и др. поля.", "Конец."],
    "# Title here. Yes\n\nA line that\nwraps. Next\n\n- One. Two.\n- three\n\n1. a\n2. b. c": ["# Title here. Yes", "A line that\nwraps.", "Next", "- One. Two.", "- three", "1. a", "2. b. c"],
    "Text.\n```python\nx = 1.\n\ny = 2\n```\nMore. End": ["Text.", "```python\nx = 1.\n\ny = 2\n```", "More.", "End"],
}


@pytest.mark.parametrize("text", CASES)
def test_rules(text):
    assert [text[a:b] for a, b in sentences(text)] == CASES[text]


TERMINATORS = [0x589, 0x61D, 0x61E, 0x61F, 0x6D4, 0x700, 0x7F9, 0x964, 0x104B, 0x1362, 0x166E, 0x17D4, 0x17D5, 0x1803, 0x1944, 0x1AA8, 0x1B5A, 0x1C7E, 0x203C, 0x2047, 0x2E3C, 0x3002, 0xA4FF, 0xA60E, 0xA6F3, 0xA876, 0xA92F, 0xA9C8, 0xAA5D, 0xABEB, 0xFE52, 0xFE56, 0xFF0E, 0xFF61, 0x11141, 0x1DA88]


@pytest.mark.parametrize("point", TERMINATORS, ids=hex)
def test_terminators_of_all_scripts(point):
    text = f"Aaa bbb{chr(point)} Ccc ddd"
    assert [text[a:b] for a, b in sentences(text)] == [f"Aaa bbb{chr(point)}", "Ccc ddd"]


@pytest.mark.parametrize(
    ("text", "size"),
    [
        ("Choose option d. Then go on.", 2),
        ("He is my ex. She left.", 2),
        ("We use vitamin z. It helps.", 2),
        ("Wir nehmen z. B. den Wert. Es ist gut.", 2),
        ("On prend p. ex. La mesure est bonne.", 1),
        ("Es una prueba, p. ej. La mesura.", 1),
        ("The note by Dr. Who is long. It ends.", 2),
    ],
)
def test_abbreviations_hold_in_their_language(text, size):
    assert len(sentences(text)) == size


def test_the_declared_language_decides_where_no_word_does():
    assert len(sentences("Wert z. Messung")) == 2 and len(sentences("Wert z. Messung", "de")) == 1


@pytest.mark.parametrize("unit", ['He said "Stop it. Wait." and left. ', "`a.b` c. D", "a.b", "x. ", '"Yes." ', "1. ", '("a.") ', "”.”"])
def test_time_grows_with_the_length_alone(unit):
    import time

    def seconds(size):
        text = unit * (size // len(unit))
        began = time.process_time()
        sentences(text)
        return time.process_time() - began

    seconds(10_000)
    assert seconds(1_000_000) < 4.0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='aB .!?"“”«»。、…\n`-#1)(ไท।\t', max_size=60))
def test_all_text_is_in_just_one_sentence(text):
    found = sentences(text)
    assert all(a < b and text[a:b] == text[a:b].strip() for a, b in found)
    assert all(b <= c for (_, b), (c, _) in zip(found, found[1:], strict=False))
    covered = "".join(text[a:b] for a, b in found)
    assert "".join(covered.split()) == "".join(text.split())


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, " \n\t ", 7), (4, "Yes. No. " * 3000, 7), (None, "Hi.", 7), (5, "A.", 8), (5, "A.", 8)], "id long, text string, start_char int")
    rows = split_sentences(df, "id", "text").collect()
    sizes = {}
    for r in rows:
        sizes[r["id"]] = sizes.get(r["id"], 0) + 1
    assert sizes == {4: 6000, None: 1, 5: 2}
    assert split_sentences(df.where("false"), "id", "text").count() == 0
