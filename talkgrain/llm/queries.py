"""Queries of this subpackage by name, and the SQL they must agree with where DuckDB can run it on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgrain.llm import languages, leaks, lookalikes, mixing, near_duplicates, personal, subjects, top_groups
from talkgrain.session import durable, read_table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.message_pairs(read_table(spark, sf_dir, "messages"))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compact form of p1_found: each message that takes part, its class of equal sets and the number of rows it is similar to."""
    return near_duplicates.classes(near_duplicates.message_links(read_table(spark, sf_dir, "messages")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.found(read_table(spark, sf_dir, "messages"))


def p3_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content and sender of every message with typed placeholders, and the spans they replace."""
    return personal.masked_messages(read_table(spark, sf_dir, "messages"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.found(read_table(spark, sf_dir, "messages"))


def p4_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, confidence and ambiguity of every message and of each stretch of it."""
    rows = languages.message_languages(read_table(spark, sf_dir, "messages"))
    return rows.select("row_id", "label", "lang", "confidence", "ambiguous", F.posexplode_outer("segments").alias("place", "segment")).select(
        "row_id", "label", "lang", "confidence", "ambiguous", "place", F.col("segment.lang").alias("segment_lang"), F.col("segment.confidence").alias("segment_confidence"), F.col("segment.ambiguous").alias("segment_ambiguous"), F.col("segment.text").alias("segment_text"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.found(read_table(spark, sf_dir, "messages"), "row_id", ["content", "sender"])


def p5_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both fields of every message in their consistent form, with the kinds of difference they had."""
    return lookalikes.normalize(read_table(spark, sf_dir, "messages"), "row_id", ["content", "sender"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_groups.newest_messages(read_table(spark, sf_dir, "messages"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.found(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p7_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every verified region, also those with edits."""
    return leaks.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(durable(p8_mixture(spark, sf_dir), "mixture"), read_table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.found(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "subject_labels"))


def p9_make_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.make_up(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "subject_labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_classes": p1_classes,
    "p3_found": p3_found,
    "p3_masked": p3_masked,
    "p4_found": p4_found,
    "p4_segments": p4_segments,
    "p5_found": p5_found,
    "p5_normalized": p5_normalized,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p7_regions": p7_regions,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_make_up": p9_make_up,
}

#: Units of lower-cased content: CJK characters alone, other runs of letters and digits whole.
_UNITS = r"regexp_extract_all(regexp_replace(lower(content), '([\x{4e00}-\x{9fff}])', ' \1 ', 'g'), '[\p{L}\p{N}]+')"


def _similar(width: int, least: int, share: float) -> str:
    run = " || ' ' || ".join(f"us[i + {k}]" for k in range(width))
    return f"""
u AS (SELECT row_id, regexp_extract(url, '(?i)/c/([0-9]+/[0-9]+)', 1) AS k, {_UNITS} AS us FROM messages WHERE content IS NOT NULL),
t AS (SELECT DISTINCT row_id, k, {run} AS tri FROM (SELECT row_id, k, us, unnest(range(1, len(us) - {width - 2})) AS i FROM u WHERE len(us) >= {width})),
n AS (SELECT row_id, k, count(*) AS n FROM t GROUP BY ALL HAVING count(*) >= {least}),
o AS (SELECT x.row_id AS a, y.row_id AS b, count(*) AS o FROM t x JOIN t y ON x.tri = y.tri AND x.row_id < y.row_id
      WHERE x.row_id IN (SELECT row_id FROM n) AND y.row_id IN (SELECT row_id FROM n) GROUP BY ALL),
p AS (SELECT a, b, x.k AS ka, y.k AS kb FROM o JOIN n x ON x.row_id = a JOIN n y ON y.row_id = b WHERE o >= {share} * (x.n + y.n - o) - 1e-9)"""


def _differs(field: str) -> str:
    """Rows whose field has a kind of difference, told by the character classes alone."""
    seen = f"regexp_replace(s, '[{lookalikes.INVISIBLE}]', '', 'g')"
    mixed = r"(\p{Latin}[\p{N}\p{M}]*[\p{Greek}\p{Cyrillic}])|(\p{Greek}[\p{N}\p{M}]*[\p{Latin}\p{Cyrillic}])|(\p{Cyrillic}[\p{N}\p{M}]*[\p{Latin}\p{Greek}])"
    emoji = r"[\x{1F000}-\x{1FAFF}\x{2190}-\x{21FF}\x{2300}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0F}]"
    joined = f"regexp_replace(s, '({emoji})\\x{{200D}}({emoji})', '\\1\\2', 'g')"
    return rf"""SELECT row_id, '{field}' AS field FROM (SELECT row_id, {field} AS s FROM messages)
WHERE regexp_matches(s, '[\x{{FF10}}-\x{{FF19}}\x{{FF21}}-\x{{FF3A}}\x{{FF41}}-\x{{FF5A}}]') OR regexp_matches({seen}, '\p{{L}}\p{{M}}')
   OR regexp_matches({joined}, '[{lookalikes.INVISIBLE}]') OR regexp_matches(s, '[\t\n\r\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]')
   OR regexp_matches(s, '[{"".join(lookalikes.several())}]') OR regexp_matches(nfc_normalize({seen}), '{mixed}')"""


ORACLES: dict[str, str] = {
    "p5_found": _differs("content") + " UNION ALL " + _differs("sender"),
    "p6_found": r"""
WITH m AS (SELECT try_cast(regexp_extract(url, '(?i)/c/([0-9]+)/([0-9]+)', 1) AS BIGINT) AS chat_id,
                  try_cast(regexp_extract(url, '(?i)/c/([0-9]+)/([0-9]+)', 2) AS BIGINT) AS msg_id, max(post_time) AS t FROM messages GROUP BY 1, 2)
SELECT chat_id, msg_id FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY t DESC, msg_id) AS rn FROM m WHERE t IS NOT NULL) WHERE rn <= 5""",
    "p7_found": rf"""
WITH s AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM eval_items),
u AS (SELECT kind, id, regexp_extract_all(regexp_replace(lower(text), '([\x{{4e00}}-\x{{9fff}}])', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+') AS us FROM s WHERE text IS NOT NULL),
t AS (SELECT DISTINCT kind, id, array_to_string(us[i:i + 11], ' ') AS run FROM (SELECT kind, id, us, unnest(range(1, len(us) - 10)) AS i FROM u WHERE len(us) >= 12))
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM t d JOIN t i ON d.run = i.run AND d.kind = 'd' AND i.kind = 'i'""",
    "p1_found": f"WITH {_similar(3, 50, 0.7)} SELECT a AS row_a, b AS row_b FROM p WHERE ka <> kb",
    "p1_classes": f"""WITH {_similar(3, 50, 0.7)},
h AS (SELECT row_id AS id, md5(string_agg(tri, '|' ORDER BY tri)) AS h FROM t WHERE row_id IN (SELECT row_id FROM n) GROUP BY row_id),
e AS (SELECT id, count(*) AS links FROM (SELECT a AS id FROM p UNION ALL SELECT b FROM p) GROUP BY id)
SELECT id, min(id) OVER (PARTITION BY h) AS class_id, count(*) OVER (PARTITION BY h) AS class_size, coalesce(links, 0) AS links FROM h LEFT JOIN e USING (id)""",
}
