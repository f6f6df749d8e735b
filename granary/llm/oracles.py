"""SQL for the subpackage's queries that SQL can express."""

from granary.llm.subset import LANGUAGES

# Fixed value: characters that are words of their own.
SINGLE = "々-〇぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ"


def words(text: str) -> str:
    """The list of a text's words."""
    return f"regexp_extract_all(regexp_replace(lower({text}), '([{SINGLE}])', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}]+')"


REPEATED = f"""WITH t AS (SELECT row_number() OVER () AS k, row_id, {words("regexp_replace(coalesce(response, ''), '\\p{Nd}+', '0', 'g')")} AS l FROM training_rows),
w AS (SELECT k, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM t),
g AS (SELECT k, i, w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p || ' ' || lead(w, 3) OVER p AS g FROM w WINDOW p AS (PARTITION BY k ORDER BY i)),
a AS (SELECT k, i FROM (SELECT k, i, row_number() OVER (PARTITION BY k, g ORDER BY i) AS n FROM g WHERE g IS NOT NULL) WHERE n > 1),
c AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest([i, i + 1, i + 2, i + 3]) AS j FROM a) GROUP BY k),
s AS (SELECT t.row_id, len(t.l)::BIGINT AS n_words, coalesce(c.n, 0) AS n_covered FROM t LEFT JOIN c ON c.k = t.k) """

ALIKE = f"""WITH t AS (SELECT DISTINCT row_id, {words("coalesce(instruction, '') || ' ' || coalesce(response, '')")} AS l FROM training_rows),
w AS (SELECT row_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM t),
b AS (SELECT DISTINCT row_id, g FROM (SELECT row_id, w || ' ' || lead(w) OVER (PARTITION BY row_id ORDER BY i) AS g FROM w) WHERE g IS NOT NULL),
n AS (SELECT row_id, count(*) AS n FROM b GROUP BY row_id),
p AS (SELECT x.row_id AS a, y.row_id AS b, count(*) AS both FROM b x JOIN b y ON x.g = y.g AND x.row_id < y.row_id GROUP BY 1, 2)
SELECT p.a AS row_id_a, p.b AS row_id_b FROM p JOIN n x ON x.row_id = p.a JOIN n y ON y.row_id = p.b WHERE p.both * 100 >= 70 * (x.n + y.n - p.both)"""


GROUPS = f"""WITH RECURSIVE t AS (SELECT DISTINCT row_id, {words("coalesce(instruction, '') || ' ' || coalesce(response, '')")} AS l FROM training_rows),
w AS (SELECT row_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM t),
b AS (SELECT DISTINCT row_id, g FROM (SELECT row_id, w || ' ' || lead(w) OVER (PARTITION BY row_id ORDER BY i) AS g FROM w) WHERE g IS NOT NULL),
h AS (SELECT row_id, md5(string_agg(g, chr(10) ORDER BY g)) AS h, count(*) AS n FROM b GROUP BY row_id),
k AS (SELECT row_id, min(row_id) OVER (PARTITION BY h) AS class_id, n FROM h),
c AS (SELECT row_id AS c, g, n FROM k JOIN b USING (row_id) WHERE row_id = class_id),
p AS (SELECT x.c AS a, y.c AS b, count(*) AS met, any_value(x.n) AS na, any_value(y.n) AS nb FROM c x JOIN c y ON x.g = y.g AND x.c <> y.c GROUP BY 1, 2),
e AS (SELECT a, b FROM p WHERE met * 100 >= 70 * (na + nb - met)),
r AS (SELECT DISTINCT class_id AS a, class_id AS b FROM k UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a, min(b) AS group_id FROM r GROUP BY a), d AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT k.row_id, k.class_id, m.group_id, coalesce(d.n, 0) AS links FROM k JOIN m ON m.a = k.class_id LEFT JOIN d ON d.a = k.class_id"""


def runs(table: str, id: str, n: str) -> str:
    return f"SELECT DISTINCT {id}, array_to_string(l[i:i + {n} - 1], ' ') AS g FROM (SELECT {id}, {n} AS need, l, unnest(range(1, len(l) - {n} + 2)) AS i FROM {table})"


LEAKED = f"""WITH i AS (SELECT DISTINCT item_id, CASE WHEN lower(lang) = 'zh' THEN 20 ELSE 12 END AS need, {words("text")} AS l FROM eval_items WHERE text IS NOT NULL),
d AS (SELECT DISTINCT doc_id, {words("text")} AS l FROM documents WHERE text IS NOT NULL),
q AS ({runs("i", "item_id", "need")}), a AS ({runs("d", "doc_id", "12")}), z AS ({runs("d", "doc_id", "20")})
SELECT DISTINCT doc_id, item_id FROM q JOIN (SELECT * FROM a UNION SELECT * FROM z) x ON x.g = q.g"""


def subset_words(text: str) -> str:
    return f"list_distinct([w for w in regexp_split_to_array(regexp_replace(lower({text}), '([\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}])', ' \\1 ', 'g'), '[^\\p{{L}}]+') if w <> ''])"


SUBSETS = f"""WITH records AS (SELECT row_id, any_value(coalesce(instruction, '')) AS instruction, any_value(coalesce(response, '')) AS response, any_value(lower(trim(coalesce(lang, '')))) AS lang FROM training_rows GROUP BY row_id),
hashed AS (SELECT row_id, lang, length(response) AS size, contains(response, '```') AS code, [md5(w) for w in {subset_words("instruction")}] AS a, [md5(w) for w in {subset_words("response")}] AS b FROM records),
f AS (SELECT row_id, md5(concat('17', ':', row_id)) AS h,
  concat_ws('/', CASE WHEN lang IN ({", ".join(f"'{x}'" for x in LANGUAGES)}) THEN lang ELSE 'other' END, CASE WHEN code THEN 1 ELSE 0 END, least(floor(log2(size + 1)), 14)::INT, coalesce(substr(list_min(a), 3, 1), ''), coalesce(substr(list_min(b), 3, 1), '')) AS cell,
  md5(concat_ws('/', coalesce(list_min(a), ''), coalesce(list_max(a), ''), coalesce(list_min(b), ''), coalesce(list_max(b), ''))) AS alike FROM hashed),
r AS (SELECT row_id, h, cell, row_number() OVER (PARTITION BY cell, alike ORDER BY h, row_id) AS nth FROM f),
p AS (SELECT row_id, cell, row_number() OVER (PARTITION BY cell ORDER BY nth, h, row_id) AS place FROM r),
g AS (SELECT row_id, row_number() OVER (ORDER BY place, cell) AS pos FROM p)
SELECT q.request_id, g.row_id FROM g JOIN subset_requests q ON g.pos <= (SELECT round(count(*) * q.keep_percent / 100.0) FROM f)"""

ORACLES: dict[str, str] = {
    "p3_shares": REPEATED + "SELECT row_id, n_words, n_covered, round(n_covered / greatest(n_words, 1), 6) AS repeated_share FROM s",
    "p3_found": REPEATED + "SELECT DISTINCT row_id FROM s WHERE n_words > 0 AND 2 * n_covered >= n_words",
    "p5_found": ALIKE,
    "p5_groups": GROUPS,
    "p6_selected": SUBSETS,
    "p7_fill": "SELECT capacity_id, (SELECT count(DISTINCT doc_id) FROM documents WHERE text <> '') AS n_docs, 0 AS n_broken, 0 AS n_over, true AS full FROM pack_capacities WHERE capacity_id IS NOT NULL",
    "p8_found": LEAKED,
}
