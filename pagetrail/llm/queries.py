"""Queries over the training-data problems, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrail.llm import groups, lookalikes, markup, mixing, near_dups, packing, pii, together


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    docs = near_dups.page_docs(_t(spark, sf, "raw_pages"))
    pairs = near_dups.NearDuplicates(docs, size=3, threshold=0.5, min_words=30).record_pairs()
    return pairs.select(F.col("a").alias("raw_id_a"), F.col("b").alias("raw_id_b"))


def p1_groups(spark: SparkSession, sf: str) -> DataFrame:
    docs = near_dups.page_docs(_t(spark, sf, "raw_pages"), redirects=True)
    return near_dups.NearDuplicates(docs).groups(docs).withColumnRenamed("id", "raw_id")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return markup.pieces(_t(spark, sf, "raw_pages"))


def p2_clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return markup.clean_text(_t(spark, sf, "raw_pages"))


def _pairs(df: DataFrame, *more: str) -> DataFrame:
    return df.select(
        F.col("a").alias("page_id_a"), F.col("b").alias("page_id_b"), F.col("c").alias("n_together"), F.col("na").alias("n_a"), F.col("nb").alias("n_b"), *more
    )


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    counts = together.TogetherCounts(_t(spark, sf, "links"))
    return _pairs(counts.surprising(min_count=6, min_lift=5.0)).select("page_id_a", "page_id_b")


def p4_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(together.TogetherCounts(_t(spark, sf, "links"), max_basket=None).counts(min_count=1))


def p4_surprise(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(together.TogetherCounts(_t(spark, sf, "links"), max_basket=None).surprising(min_count=1), "lift", "expected", "log10_p", "q_value")


def p4_significant(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs of all baskets whose count is too high for chance at a false-discovery rate of 0.05."""
    return p4_surprise(spark, sf).filter("q_value <= 0.05")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return groups.linked_groups(_t(spark, sf, "raw_pages"))


def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    return groups.record_groups(_t(spark, sf, "raw_pages"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalikes.look_alike_links(_t(spark, sf, "parsed_links"), _t(spark, sf, "pages"))


def p6_canonical_titles(spark: SparkSession, sf: str) -> DataFrame:
    titles = _t(spark, sf, "pages").select("page_id", F.col("title").alias("text"))
    return titles.join(lookalikes.canonical_forms(titles.select("text"), titles), "text").select("page_id", F.col("form").alias("canonical_title"))


def p6_canonical_targets(spark: SparkSession, sf: str) -> DataFrame:
    """One row per link; null and empty targets stay as they are."""
    links = _t(spark, sf, "parsed_links").select("link_id", F.col("target").alias("text"))
    forms = lookalikes.canonical_forms(links.filter("text <> ''"), _t(spark, sf, "pages").select(F.col("title").alias("text")))
    return links.join(forms, "text", "left").select("link_id", F.coalesce("form", "text").alias("canonical_target"))


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.containers(_t(spark, sf, "documents"), _t(spark, sf, "pack_sizes"))


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    return packing.report(p7_containers(spark, sf), _t(spark, sf, "pack_sizes"))


def p7_rules(spark: SparkSession, sf: str) -> DataFrame:
    return packing.rules(p7_containers(spark, sf), _t(spark, sf, "pack_sizes"))


def p8_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.Mixture(_t(spark, sf, "documents"), _t(spark, sf, "mix_targets")).rows


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.Mixture(_t(spark, sf, "documents"), _t(spark, sf, "mix_targets")).report


def p8_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each source that has texts meets its share of the tokens, to half a point or to one document, within its repeats.

    Where a listed source has no text, the others keep their proportions, so shares count among those that have.
    """
    mix = mixing.Mixture(_t(spark, sf, "documents"), _t(spark, sf, "mix_targets"))
    one = mix.rows.groupBy("source").agg(F.max("tokens").alias("one"))
    given = mix.report.join(one, "source")
    total, listed = given.agg(F.sum("tokens"), F.sum("target_share")).first()  # one row
    off = F.abs(F.col("tokens") - F.col("target_share") * ((total or 0) / (listed or 1)))
    met = off <= F.greatest(F.col("one"), F.lit(0.005 * (total or 0)))
    return given.select("source", F.round("target_share", 6).alias("target_share"), met.alias("share_met"), (F.col("repeats") <= F.col("max_repeats")).alias("repeats_met"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return pii.personal_data(_t(spark, sf, "documents"))


def p9_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return pii.redacted(_t(spark, sf, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    mine = (
        p1_found, p1_groups, p2_found, p2_clean_text, p4_found, p4_counts, p4_surprise, p4_significant, p5_found, p5_groups,
        p6_found, p6_canonical_titles, p6_canonical_targets, p7_containers, p7_report, p7_rules, p8_mixture, p8_report, p8_rules, p9_found, p9_redacted,
    )
    return {f.__name__: f for f in mine}


_TOGETHER = """
WITH d AS (SELECT DISTINCT from_page_id f, to_page_id t FROM links WHERE from_page_id <> to_page_id),
k AS (SELECT f FROM d GROUP BY f HAVING count(*) <= {most}),
e AS (SELECT d.f, d.t FROM d JOIN k USING (f)),
n AS (SELECT t, count(*) n FROM e GROUP BY t),
c AS (SELECT a.t a, b.t b, count(*) c FROM e a JOIN e b ON a.f = b.f AND a.t < b.t GROUP BY 1, 2)
SELECT c.a AS page_id_a, c.b AS page_id_b{more} FROM c JOIN n x ON x.t = c.a JOIN n y ON y.t = c.b WHERE {test}"""

_GROUPS = r"""
WITH RECURSIVE r AS (
  SELECT raw_id, CASE WHEN title <> '' THEN title END AS title,
    regexp_replace(regexp_replace(redirect._title, '^:', ''), '#.*$', '', 's') AS target FROM raw_pages),
u AS (SELECT raw_id, title, CASE WHEN target <> '' THEN CASE WHEN regexp_matches(target, '^[a-z]') THEN upper(target[1]) || target[2:] ELSE target END END AS target FROM r),
first AS (SELECT title, min(raw_id) AS b FROM u WHERE title IS NOT NULL GROUP BY title),
e AS (SELECT u.raw_id AS a, f.b FROM u JOIN first f ON f.title = u.title UNION SELECT u.raw_id, f.b FROM u JOIN first f ON f.title = u.target),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
walk AS (SELECT a AS v, a AS w FROM s UNION SELECT walk.v, s.b FROM walk JOIN s ON s.a = walk.w),
g AS (SELECT v AS raw_id, min(w) AS group_id FROM walk GROUP BY v)
"""


_TEXT = "coalesce(array_to_string([x.text FOR x IN revision], ''), '')"
_P1 = rf"""
WITH w AS (SELECT raw_id, regexp_extract_all(lower({_TEXT}), '[\p{{L}}\p{{N}}_]+') AS ws FROM raw_pages WHERE coalesce(redirect._title, '') = ''),
s AS (SELECT DISTINCT raw_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS run FROM (SELECT raw_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 30)),
n AS (SELECT raw_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.raw_id AS x, b.raw_id AS y, count(*) AS c FROM s a JOIN s b ON a.run = b.run AND a.raw_id < b.raw_id GROUP BY 1, 2)
SELECT x AS raw_id_a, y AS raw_id_b FROM c JOIN n p ON p.raw_id = x JOIN n q ON q.raw_id = y WHERE c >= 0.5 * (p.n + q.n - c)"""


_P1_GROUPS = rf"""
WITH RECURSIVE w AS (SELECT raw_id, regexp_extract_all(lower({_TEXT}), '[\p{{L}}\p{{N}}_]+') AS ws FROM raw_pages),
s AS (SELECT DISTINCT raw_id, array_to_string(ws[i:i + 4], ' ') AS run FROM (SELECT raw_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT raw_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.raw_id AS x, b.raw_id AS y, count(*) AS c FROM s a JOIN s b ON a.run = b.run AND a.raw_id <> b.raw_id GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN n p ON p.raw_id = x JOIN n q ON q.raw_id = y WHERE c >= 0.8 * (p.n + q.n - c)),
walk AS (SELECT x AS v, y AS w FROM e UNION SELECT walk.v, e.y FROM walk JOIN e ON e.x = walk.w),
g AS (SELECT v AS raw_id, least(v, min(w)) AS group_id FROM walk GROUP BY v)
SELECT r.raw_id, coalesce(g.group_id, r.raw_id) AS group_id FROM raw_pages r LEFT JOIN g USING (raw_id)"""


def _same_look(text: str) -> str:
    """Width, spaces, unseen characters, equal shapes and accents by tables alone."""
    shapes = lookalikes.SHAPE | {"ё": "ë", "ї": "ï", "Ё": "Ë", "Ї": "Ï"}
    spaces = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
    wide = f"array_to_string([CASE WHEN ord(ch) BETWEEN 65281 AND 65374 THEN chr(ord(ch) - 65248) ELSE ch END FOR ch IN string_split({text}, '')], '')"
    seen = rf"regexp_replace({wide}, '[\p{{Cf}}\x{{34F}}\x{{180B}}-\x{{180F}}\x{{FE00}}-\x{{FE0F}}]', '', 'g')"
    plain = f"replace(replace({seen}, 'ﬁ', 'fi'), 'ﬂ', 'fl')"
    return f"nfc_normalize(translate({plain}, '{''.join(shapes)}{spaces}', '{''.join(shapes.values())}{' ' * len(spaces)}'))"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1,
        "p1_groups": _P1_GROUPS,
        "p6_found": f"""WITH l AS (SELECT link_id, target, {_same_look("target")} AS form FROM parsed_links WHERE target <> ''),
          p AS (SELECT page_id, title, {_same_look("title")} AS form FROM pages WHERE title <> '')
          SELECT link_id, page_id FROM l JOIN p USING (form) WHERE target <> title""",
        "p7_rules": """SELECT pack_name, (SELECT count(*) FROM documents WHERE text <> '') AS texts,
          0 AS wrongly_split, 0 AS gaps, 0 AS over_tokens, 0 AS over_segments, 0 AS over_loss FROM pack_sizes""",
        "p8_rules": """SELECT lower(trim(source)) AS source, round(target_share, 6) AS target_share, true AS share_met, true AS repeats_met FROM mix_targets
          WHERE lower(trim(source)) IN (SELECT lower(trim(source)) FROM documents WHERE text <> '')""",
        "p4_found": _TOGETHER.format(most=200, more="", test="c.c >= 6 AND c.c * (SELECT count(*) FROM k) >= 5 * x.n * y.n"),
        "p4_counts": _TOGETHER.format(most="1e18", more=", c.c AS n_together, x.n AS n_a, y.n AS n_b", test="true"),
        "p5_found": _GROUPS + "SELECT raw_id, group_id FROM g WHERE group_id IN (SELECT group_id FROM g GROUP BY 1 HAVING count(*) > 1)",
        "p5_groups": _GROUPS + "SELECT r.raw_id, coalesce(g.group_id, r.raw_id) AS group_id FROM raw_pages r LEFT JOIN g USING (raw_id)",
    }
