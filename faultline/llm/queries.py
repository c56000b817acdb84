"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.tables import read, shared_folder


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from faultline.llm.html import extract

    pages = extract(read(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_boilerplate")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from faultline.llm import toxicity
    from faultline.llm.labelled import held_out

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    scored = model.score(docs, ("doc_id",))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from faultline.llm.embeddings import embedding_classes

    classes = embedding_classes(read(spark, sf_dir, "embeddings"), threshold=0.95)
    return classes.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from faultline.llm.decontaminate import phrase_hits

    hits = phrase_hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), window=10)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return hits.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from faultline.llm.simhash import simhash_classes

    classes = simhash_classes(read(spark, sf_dir, "documents"), shingle=3, bits=2)
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from faultline.llm.tokens import token_counts

    counts = token_counts(read(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from faultline.llm import quality
    from faultline.llm.labelled import held_out

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from faultline.llm.substrings import remove_repeats

    out = remove_repeats(read(spark, sf_dir, "documents"), length=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from faultline.llm.mixing import mix_taken

    taken = mix_taken(read(spark, sf_dir, "documents"), weights=(5, 2, 1), max_repeat=3)
    return taken.select("doc_id", "size", "source_size", "target", "taken", "source")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from faultline.llm.passages import remove_passages

    out = remove_passages(read(spark, sf_dir, "documents").select("doc_id", "text"), window=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_words").cast("binary"), 256).alias("kept_sha256"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from faultline.llm.alignment import align

    found = align(read(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model")))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return found.with_rest(found.texts.withColumn("groups_sha256", digest).drop("groups"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from faultline.llm.spelling import spelling_groups

    return spelling_groups(read(spark, sf_dir, "documents"), least_length=6, least_count=5, every=199, factor=5)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    from faultline.llm.grammar import read_ids, write_ids

    path = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(read(spark, sf_dir, "documents"), path, str(public_tokenizers.path("byte_bpe_50k.json")), end_id=2)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_toxicity, op3_embedding_near_dedup, op4_benchmark_decontamination, op5_simhash, op6_token_counts, op7_quality, op8_suffix_array_dedup, op9_source_mixing, op10_substring_dedup, op11_token_alignment, op12_spelling_variants, op13_token_files, pipeline)}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: All pairs of vectors; components by following links.
OP3 = """WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT p.vec_id AS a, r.vec_id AS b FROM u p JOIN u r ON p.vec_id <> r.vec_id AND len(p.e) = len(r.e) AND list_cosine_similarity(p.e, r.e) >= 0.95),
reach AS (SELECT vec_id, vec_id AS top FROM v UNION SELECT l.b, reach.top FROM reach JOIN l ON l.a = reach.vec_id),
c AS (SELECT vec_id, min(top) AS component_id FROM reach GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT c.vec_id, coalesce(n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""

LOWERED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Every window of every item against the words of every document.
OP4 = rf"""WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {LOWERED} AS w FROM benchmark),
bw AS (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
phrases AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM bw),
d AS (SELECT doc_id, {LOWERED} AS w FROM documents), p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
q AS (SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS x FROM p),
c AS MATERIALIZED (SELECT doc_id, i, n, array_to_string(x[1:n], ' ') AS phrase FROM q, (SELECT DISTINCT n FROM phrases) WHERE len(x) >= n),
h AS (SELECT doc_id, i, n, item FROM c JOIN phrases USING (n, phrase)),
m AS (SELECT doc_id, i, max(n) AS n FROM h GROUP BY 1, 2),
r AS (SELECT p.doc_id, p.i, max(p.i + m.n - 1) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS reach FROM p LEFT JOIN m ON p.doc_id = m.doc_id AND p.i = m.i),
g AS (SELECT doc_id, count(*) FILTER (reach >= i) AS n_hit FROM r GROUP BY 1), f AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM h GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN f USING (doc_id)"""

#: Every 100-byte window by its hash.
OP8 = """WITH d AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS x FROM documents), p AS (SELECT doc_id, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM d),
w AS (SELECT doc_id, i, y, CASE WHEN count(*) OVER o = 100 THEN md5(string_agg(y, '') OVER o) END AS h FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 99 FOLLOWING)),
a AS (SELECT doc_id, i, y, h IS NOT NULL AND row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1 AS again FROM w),
r AS (SELECT doc_id, i, y, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM a),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS starts FROM r),
g AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans, string_agg(y, '' ORDER BY i) FILTER (NOT gone) AS kept FROM s GROUP BY 1)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)"""

#: The queue as one sorted list.
OP9 = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, left(md5(concat_ws('|', CAST(doc_id AS VARCHAR), text)), 15) AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM s),
w AS (SELECT *, CAST(CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight FROM k),
o AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total, CAST(coalesce(sum(source_size * 3) OVER f, 0) AS DOUBLE) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER f, 0) AS weight_left
  FROM w WINDOW f AS (ORDER BY source_size / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - capped) / weight_left AS level FROM o), m AS (SELECT arg_min(level, (capped, level)) AS level FROM l WHERE source_size * 3 >= level * weight),
t AS (SELECT l.source, source_size, total, least(CAST(source_size * 3 AS DOUBLE), m.level * weight) AS target FROM l, m),
q AS (SELECT d.*, source_size, target, total, sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size, r ROWS UNBOUNDED PRECEDING) AS through FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (turn * source_size + through) / target AS finish FROM q, (VALUES (0), (1), (2)) AS v(turn) WHERE turn * source_size + through - size < target),
a AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, doc_id, turn, r ROWS UNBOUNDED PRECEDING) - size AS ahead FROM c),
x AS (SELECT r, sum(size) AS taken FROM a WHERE ahead + size / 2 <= total GROUP BY 1)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, source FROM q LEFT JOIN x USING (r)"""

#: Every window of 50 words by its hash.
OP10 = rf"""WITH d AS (SELECT doc_id, {WORDS} AS x FROM documents), p AS (SELECT doc_id, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM d),
w AS (SELECT doc_id, i, y, CASE WHEN count(*) OVER o = 50 THEN md5(string_agg(y, ' ') OVER o) END AS h FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
a AS (SELECT doc_id, i, y, h IS NOT NULL AND min(doc_id) OVER (PARTITION BY h) < doc_id AS again FROM w),
r AS (SELECT doc_id, i, y, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM a),
g AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(y, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM r GROUP BY 1)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)"""

ORACLES = {"op3_embedding_near_dedup": OP3, "op4_benchmark_decontamination": OP4, "op8_suffix_array_dedup": OP8, "op9_source_mixing": OP9, "op10_substring_dedup": OP10}
