"""The subpackage's queries: each applies one operator, with production parameters, to its whole table and derives the fixed columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fim, html_text, jaccard, langid, licenses, lm_bloom, mih, packing, quality, resample, substring, toxicity


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(of: int):
    return F.crc32(F.col("doc_id").cast("string")) % of


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.mark_contamination(docs, _table(spark, sf_dir, "benchmark"))
    names = F.concat_ws(",", F.array_sort(F.col("_items").cast("array<string>")))
    return marked.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("_n_hit") > 0).alias("contaminated"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("_text").alias("text"), F.char_length("_text").cast("long").alias("n_chars"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("grade"))
    return toxicity.score(docs, toxicity.fit(docs, labels))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(_fold(4) != 2).select("doc_id", "text", "lang"))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (_fold(4) == 2).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.col("_rejected").alias("rejected"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_groups(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return mih.nearest(table, table.where("vec_id % 100 = 0"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = lm_bloom.score(docs, docs.where(_fold(7) != 2))
    return found.withColumn("held_out", _fold(7) == 2).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample.resample(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.col("_n_features").alias("n_features"), F.col("_weight").alias("weight"), F.col("_score").alias("score"), F.col("_rank").alias("rank"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    named = lambda *lists: F.array_join(F.array_sort(F.array_distinct(F.concat(*lists))), ",")
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.size("_base").cast("long").alias("n_base"),
        F.array_min("_base.first").alias("first_word"),
        F.array_max("_base.first").alias("last_word"),
        named(F.col("_base.label")).alias("base_labels"),
        named(F.col("_base.label"), F.col("_detections.label")).alias("labels"),
        F.col("_score").alias("score"),
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c, 256)
    return made.select(
        "doc_id",
        F.col("_n").alias("n"),
        F.col("_form").alias("form"),
        F.col("_prefix_chars").alias("prefix_chars"),
        F.col("_middle_chars").alias("middle_chars"),
        digest("_output").alias("output_sha256"),
        digest(fim.restored(F.col("_output"), F.col("_form"))).alias("restored_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_WORD = r"'[^\x20\x09-\x0D]+'"


#: crc32 of the UTF-8 bytes of a word, by the table of its polynomial
_CRC = """tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
byte AS (SELECT word, list_transform(range(1, len(hex(encode(word))) + 1, 2), lambda i: ('0x' || substr(hex(encode(word)), i, 2))::bigint) AS b FROM (SELECT DISTINCT word FROM words)),
crc AS (SELECT word, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS k FROM byte, tab)"""


def _licenses_sql() -> str:
    """The same rules over words between three spaces each, of which a match takes two or three before and one after its words; suppression by pairs."""
    every = [*licenses.RULES, *(licenses.Rule(p.split(" ")[0], 0, label, p) for p, label in licenses.BASE)]
    wide = lambda body: re.sub(r" (\??)", lambda m: "(?: {2,3})?" if m[1] else " {2,3}", body) + " "
    values = ", ".join(f"({i}, '{r.keyword}', {r.priority}, '{r.label}', '{wide(r.body)}')" for i, r in enumerate(every))
    scores = ", ".join(map(str, licenses.SCORES))
    return f"""
WITH rule(i, keyword, priority, label, pat) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
t AS (SELECT r, '   ' || array_to_string(w, '   ') || '   ' AS s FROM d),
m AS (SELECT r, i, string_split(regexp_replace(s, '(' || pat || ')', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS p FROM t JOIN rule ON contains(s, '   ' || keyword || '   ') WHERE regexp_matches(s, pat)),
q AS (SELECT r, i, k, p[k] AS piece, len(regexp_extract_all(p[k], '[^ \x01\x02]+')) AS n FROM (SELECT *, unnest(range(1, len(p) + 1)) AS k FROM m)),
f AS (SELECT *, sum(n) OVER (PARTITION BY r, i ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS first FROM q),
found AS (SELECT r, i, priority, label, cast(first AS bigint) AS first, cast(first + len(regexp_extract_all(split_part(piece, chr(2), 1), '[^ \x01\x02]+')) - 1 AS bigint) AS last FROM f JOIN rule USING (i) WHERE k > 1),
base AS (SELECT * FROM found WHERE priority = 0),
own AS (SELECT * FROM found WHERE priority > 0),
kept AS (SELECT * FROM own a WHERE NOT EXISTS (SELECT 1 FROM own b WHERE b.r = a.r AND b.first <= a.first AND b.last >= a.last AND b.priority <= a.priority AND (b.first < a.first OR b.last > a.last OR b.priority < a.priority OR b.i < a.i))),
bs AS (SELECT r, count(*) AS n, min(first) AS lo, max(first) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM base GROUP BY r),
al AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS l, max([0.0, {scores}][priority + 1]) AS s FROM (SELECT r, label, priority FROM base UNION ALL SELECT r, label, priority FROM kept) GROUP BY r)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, cast(coalesce(n, 0) AS bigint) AS n_base, lo AS first_word, hi AS last_word, coalesce(bs.l, '') AS base_labels, coalesce(al.l, '') AS labels, cast(coalesce(s, 0) AS double) AS score
FROM d LEFT JOIN bs USING (r) LEFT JOIN al USING (r)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_resampling": f"""
WITH sw AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, {_ALNUM})) AS word FROM documents),
tw AS (SELECT unnest(regexp_extract_all({_LOWER}, {_ALNUM})) AS word FROM benchmark),
words AS (SELECT word FROM sw UNION ALL SELECT word FROM tw), {_CRC},
sk AS (SELECT k, count(*) AS s FROM sw JOIN crc USING (word) GROUP BY k),
tk AS (SELECT k, count(*) AS t FROM tw JOIN crc USING (word) GROUP BY k),
tot AS (SELECT (SELECT count(*) FROM sw) AS s_all, (SELECT count(*) FROM tw) AS t_all),
g AS (SELECT k, cast(floor(1000 * ln(cast(coalesce(t, 0) + 1 AS double) * (s_all + 10000) / (cast(s + 1 AS double) * (t_all + 10000)))) AS bigint) AS gain FROM sk LEFT JOIN tk USING (k), tot),
w AS (SELECT doc_id, count(*) AS n, cast(sum(gain) AS bigint) AS weight FROM sw JOIN crc USING (word) JOIN g USING (k) GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(n, 0) AS n, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint AS h FROM documents LEFT JOIN w USING (doc_id)),
s AS (SELECT *, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double))) AS bigint) AS score FROM d),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS able FROM s WHERE n >= 20)
SELECT doc_id, cast(n AS bigint) AS n_features, cast(weight AS bigint) AS weight, cast(score AS bigint) AS score, CASE WHEN rank <= 10 * able // 100 THEN rank END AS rank FROM s LEFT JOIN r USING (doc_id)""",
        "op12_licenses": _licenses_sql(),
        "op13_fill_in_middle": r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS x FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS l, ('0x' || substr(x, 1, 8))::ubigint AS h1, ('0x' || substr(x, 9, 8))::ubigint AS h2, ('0x' || substr(x, 17, 8))::ubigint AS h3, ('0x' || substr(x, 25, 8))::ubigint AS h4 FROM h),
r AS (SELECT *, len(l) AS n, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS b FROM u),
c AS (SELECT *, array_to_string(l[1:a], '') AS p, array_to_string(l[a + 1:b], '') AS m, array_to_string(l[b + 1:], '') AS s,
      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM r)
SELECT doc_id, cast(n AS bigint) AS n, form, CASE WHEN form <> 'plain' THEN cast(length(p) AS bigint) END AS prefix_chars, CASE WHEN form <> 'plain' THEN cast(length(m) AS bigint) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM c""",
        "op1_decontamination": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark),
bw AS (SELECT item_id, least(10, len(w)) AS n, w, unnest(range(greatest(len(w) - 9, 1))) AS p FROM b WHERE len(w) > 0),
bs AS (SELECT DISTINCT item_id, n, array_to_string(w[p + 1 : p + n], ' ') AS s FROM bw),
ns AS (SELECT DISTINCT n FROM bs),
dw AS (SELECT doc_id, n, w, unnest(range(len(w) - n + 1)) AS p FROM d, ns WHERE len(w) >= n),
hit AS (SELECT dw.doc_id, dw.p, dw.n, bs.item_id FROM dw JOIN bs ON dw.n = bs.n AND array_to_string(dw.w[dw.p + 1 : dw.p + dw.n], ' ') = bs.s),
spot AS (SELECT DISTINCT doc_id, p + k AS pos FROM (SELECT doc_id, p, unnest(range(n)) AS k FROM hit)),
hw AS (SELECT doc_id, count(*) AS n_hit FROM spot GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, cast(len(d.w) AS bigint) AS n_words, cast(coalesce(n_hit, 0) AS bigint) AS n_hit, cast(coalesce(n_items, 0) AS bigint) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)""",
        "op7_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(greatest(len(w) - 2, 1))) AS p FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p + 1 : p + 3], ' ') AS g FROM x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * inter >= 90 * (na.n + nb.n - inter)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, cast(coalesce(n.n, 0) AS bigint) AS n_shingles, m.component_id FROM d JOIN m ON m.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
        "op8_substring_dedup": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(len(w) - 12)) AS p FROM d WHERE len(w) >= 13),
s AS (SELECT doc_id, p, array_to_string(w[p + 1 : p + 13], ' ') AS g FROM x),
o AS (SELECT g, min(doc_id) AS o FROM s GROUP BY g),
h AS (SELECT doc_id, p FROM s JOIN o USING (g) WHERE o.o < doc_id),
gone AS (SELECT DISTINCT doc_id, p + k AS pos FROM (SELECT doc_id, p, unnest(range(13)) AS k FROM h)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS t FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, cast(len(d.w) AS bigint) AS n_words, cast(len(d.w) - coalesce(kept.n, 0) AS bigint) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    }
