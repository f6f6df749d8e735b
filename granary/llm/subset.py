"""A varied subset of a given size: multi-attribute grid round-robin, in SQL alone.

Each record is put into a cell of a grid of attributes: language, code, length and the
smallest word hashes of instruction and response, which alike records share. Records of a
cell are ranked so that the first of each group of alike ones (equal smallest and largest
word hash) come before the second ones; then records are ordered by rank and cell, and the
first k are kept. How many of each cell that means follows from the sizes of the cells, whose
number the grid bounds, so no global sort is made. Ranks inside hot cells and groups are
counted in sub-ranges of the order, whose sizes are added up first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from granary.session import cut

MOST_REQUESTS = 1000
# Languages with cells of their own.
LANGUAGES = ("en", "de", "fr", "es", "ru", "zh", "ja")

#: Distinct lower-case words of a text; each Chinese or Japanese character is a word.
WORDS = "array_distinct(array_remove(split(regexp_replace(lower({0}), '([\\\\p{{IsHan}}\\\\p{{IsHiragana}}\\\\p{{IsKatakana}}])', ' $1 '), '[^\\\\p{{L}}]+'), ''))"

FEATURES = f"""
WITH records AS (
  SELECT row_id, first(coalesce(instruction, '')) AS instruction, first(coalesce(response, '')) AS response, first(lower(trim(coalesce(lang, '')))) AS lang
  FROM {{records}} WHERE row_id IS NOT NULL GROUP BY row_id
), hashed AS (
  SELECT row_id, lang, length(response) AS size, contains(response, '```') AS code,
         transform({WORDS.replace("{0}", "instruction")}, w -> md5(w)) AS a, transform({WORDS.replace("{0}", "response")}, w -> md5(w)) AS b
  FROM records
)
SELECT row_id, md5(concat({{seed}}, ':', row_id)) AS h,
       concat_ws('/', CASE WHEN lang IN ({", ".join(f"'{x}'" for x in LANGUAGES)}) THEN lang ELSE 'other' END, CASE WHEN code THEN 1 ELSE 0 END,
                 least(floor(log2(size + 1)), 14), coalesce(substr(array_min(a), 3, 1), ''), coalesce(substr(array_min(b), 3, 1), '')) AS cell,
       md5(concat_ws('/', coalesce(array_min(a), ''), coalesce(array_max(a), ''), coalesce(array_min(b), ''), coalesce(array_max(b), ''))) AS alike
FROM hashed
"""

#: Rank among the alike ones of a cell, counted in 256 sub-ranges of the order.
AMONG_ALIKE = """
WITH sizes AS (
  SELECT cell, alike, substr(h, 1, 2) AS part, count(*) AS n FROM {features} GROUP BY 1, 2, 3
), before AS (
  SELECT cell, alike, part, sum(n) OVER (PARTITION BY cell, alike ORDER BY part) - n AS ahead FROM sizes
)
SELECT f.row_id, f.h, f.cell, b.ahead + row_number() OVER (PARTITION BY f.cell, f.alike, substr(f.h, 1, 2) ORDER BY f.h, f.row_id) AS nth
FROM {features} f JOIN before b ON f.cell = b.cell AND f.alike = b.alike AND substr(f.h, 1, 2) = b.part
"""

#: Rank in the cell by (nth, h): the order is cut into blocks of ``nth`` and, for low ``nth``, of ``h``.
IN_CELL = """
WITH placed AS (
  SELECT row_id, h, cell, nth, CASE WHEN nth <= 64 THEN nth ELSE 65 + (nth - 65) DIV 4096 END AS block, CASE WHEN nth <= 64 THEN substr(h, 1, 2) ELSE '' END AS part
  FROM {ranked}
), sizes AS (
  SELECT cell, block, part, count(*) AS n FROM placed GROUP BY 1, 2, 3
), before AS (
  SELECT cell, block, part, sum(n) OVER (PARTITION BY cell ORDER BY block, part) - n AS ahead FROM sizes
)
SELECT p.row_id, p.cell, b.ahead + row_number() OVER (PARTITION BY p.cell, p.block, p.part ORDER BY p.nth, p.h, p.row_id) AS place
FROM placed p JOIN before b ON p.cell = b.cell AND p.block = b.block AND p.part = b.part
"""

#: How many records of each cell a request keeps: whole rounds, and one more of the first cells.
#: The requests stand in the text of the query, so each cell is only repeated for each of them.
QUOTAS = """
WITH cells AS (
  SELECT cell, count(*) AS n FROM {features} GROUP BY cell
), asked AS (
  SELECT r.request_id, c.cell, c.n, sum(c.n) OVER w AS total, r.keep_percent,
         sum(c.n) OVER (PARTITION BY r.request_id ORDER BY c.n) AS below, count(*) OVER (PARTITION BY r.request_id ORDER BY c.n) AS gone, count(*) OVER w AS all_cells
  FROM cells c LATERAL VIEW inline(array([requests])) r AS request_id, keep_percent
  WINDOW w AS (PARTITION BY r.request_id)
), sized AS (
  SELECT *, least(total, CAST(round(total * keep_percent / 100.0) AS BIGINT)) AS k, below + n * (all_cells - gone) AS spent FROM asked
), rounds AS (
  SELECT *, max(CASE WHEN spent <= k THEN n ELSE 0 END) OVER (PARTITION BY request_id) AS done FROM sized
), used AS (
  SELECT *, sum(least(n, done)) OVER (PARTITION BY request_id) AS kept, sum(CASE WHEN n > done THEN 1 ELSE 0 END) OVER (PARTITION BY request_id) AS alive FROM rounds
), deep AS (
  SELECT request_id, cell, n, done + CASE WHEN alive > 0 THEN (k - kept) DIV alive ELSE 0 END AS depth, CASE WHEN alive > 0 THEN (k - kept) % alive ELSE 0 END AS extra FROM used
), turned AS (
  SELECT *, row_number() OVER (PARTITION BY request_id, n > depth ORDER BY cell) AS turn FROM deep
)
SELECT request_id, cell, least(n, depth) + CASE WHEN n > depth AND turn <= extra THEN 1 ELSE 0 END AS quota FROM turned
"""


def varied_subsets(records: DataFrame, requests: DataFrame, seed: int = 17) -> DataFrame:
    """(request_id, row_id): for each request just the asked share of the distinct records.

    records: row_id, instruction, response, lang; requests: request_id, keep_percent. A record
    delivered again is one record; null texts are empty texts; a row without an id is none. A
    share over 100 keeps all, one of 0 none; ties are broken by hash and id.
    """
    spark = records.sparkSession
    asked = requests.where("request_id is not null and keep_percent >= 0").select("request_id", "keep_percent").distinct().limit(MOST_REQUESTS + 1).collect()
    if len(asked) > MOST_REQUESTS:
        raise ValueError(f"more than {MOST_REQUESTS} requests; ask for them in parts")
    if not asked:
        return spark.createDataFrame([], "request_id long, row_id long")
    listed = ", ".join(f"named_struct('request_id', {int(i)}L, 'keep_percent', {int(p)})" for i, p in sorted(asked))
    features = cut(spark.sql(FEATURES.replace("{seed}", f"'{seed}'"), records=records))
    ranked = spark.sql(AMONG_ALIKE, features=features)
    placed = spark.sql(IN_CELL, ranked=cut(ranked))
    quotas = spark.sql(QUOTAS.replace("[requests]", listed), features=features)
    return spark.sql("SELECT q.request_id, p.row_id FROM {placed} p JOIN {quotas} q ON p.cell = q.cell AND p.place <= q.quota", placed=placed, quotas=quotas)
