"""The operators' queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from presswork.llm import (
    balltree, bpe, decontamination, edits, materialise, mixing, neardup, pii, quality, samples, sharding, spelling,
    toxicity, whitening)
from presswork.session import shared_folder

#: Target weights of the mixture; sources not named weigh 1.
MIX_WEIGHTS = {"src0": 2.0, "src1": 3.0, "src2": 0.5}
MIX_SEED = "mix-1"
SHARDS = 24
#: Tokens of a sequence, its end and padding token, and sequences of a shard file.
SEQUENCE, END_ID, SHARD_SEQUENCES = 512, 49407, 8192
ORDER_KEY = 20240607
#: Stands for the secret that a user would pass.
PII_KEY = "surrogates-1"
TOXIC_FROM = 0.3
#: Labelled rows that the toxicity machine is fitted on, at most.
TOXIC_ROWS = 12_000
WORD_VOCABULARY = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_digests(encoded: DataFrame) -> DataFrame:
    """Columns that stand for the ids and the decoded text of each row, which stay in place."""
    listed = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return encoded.withColumns({
        "n_tokens": F.size("ids").cast("long"),
        "ids_sha256": F.sha2(listed, 256),
        "decoded_sha256": F.sha2("decoded", 256)})


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every whole text and of the text decoded from them."""
    vocabulary = bpe.share(spark, public_tokenizers.path(WORD_VOCABULARY))
    encoded = bpe.encode(table(spark, sf_dir, "documents"), vocabulary,
                         decoded="decoded", keep=["doc_id"])
    return token_digests(encoded).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every whole text, and whether the base rule and the learned list keep it."""
    docs = table(spark, sf_dir, "documents")
    sample = samples.labelled_sample(docs, table(spark, sf_dir, "labels"), "quality")
    rules = quality.learn_rules(quality.text_statistics(sample))
    base_failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    return quality.text_statistics(docs, keep=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & quality.deciding_rule(rules).isNull()).alias("kept"))


def op3_top_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest inner products of every hundredth vector with all others."""
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", balltree.scaled(F.col("embedding")).alias("vector"))
    return balltree.top_inner_products(vectors, F.col("vec_id") % 100 == 0)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of every document of the mixture, in training order."""
    docs = table(spark, sf_dir, "documents")
    rates = mixing.repetition_rates(docs, MIX_WEIGHTS)
    return mixing.replicate(docs, rates, MIX_SEED)


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token sequence of all documents with its place in the shards just written."""
    vocabulary = bpe.share(spark, public_tokenizers.path(WORD_VOCABULARY))
    docs = table(spark, sf_dir, "documents")
    dictionary = materialise.learn_dictionary(docs, vocabulary, SEQUENCE, END_ID)
    rows = materialise.sequences(docs, vocabulary, SEQUENCE, END_ID, dictionary=dictionary)
    slotted, size = materialise.assign_slots(rows, ORDER_KEY, rows.columns)
    written = materialise.write_shards(
        slotted, size, shared_folder(spark, "token-shards"), SEQUENCE, SHARD_SEQUENCES,
        dictionary)
    return written.drop("path")


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced by surrogates."""
    return pii.replace_entities(table(spark, sf_dir, "documents"), PII_KEY)


def derived_edits() -> Column:
    """Three edits of each text, placed by a hash of its id: a cut, a repeated passage, a new word."""
    def place(n: int) -> str:
        return f"cast(pmod(xxhash64(doc_id, {n}), greatest(length(text), 1)) AS int)"
    return F.expr(f"""array(
        named_struct('start', {place(1)}, 'stop', {place(1)} + 40, 'text', ''),
        named_struct('start', {place(2)}, 'stop', {place(2)}, 'text', substring(text, {place(3)} + 1, 80)),
        named_struct('start', {place(4)}, 'stop', {place(4)} + 5, 'text', ' edited '))""")


def op7_edited_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after three edits each."""
    vocabulary = bpe.share(spark, public_tokenizers.path(WORD_VOCABULARY))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", derived_edits().alias("edits"))
    return edits.count_edited(docs, vocabulary).select(
        "doc_id", "n_before", "n_after", "n_leaves", "n_encoded", F.sha2("edited", 256).alias("edited_sha256"))


def op8_shard_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal byte size; equal texts stand together."""
    sizes = table(spark, sf_dir, "documents").select(
        "doc_id", sharding.document_size("text").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    sharded = sharding.shard_by_bytes(sizes, SHARDS, ["text_crc32", "doc_id", "size"])
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def toxicity_machine(spark: SparkSession, sf_dir: str) -> toxicity.Machine:
    """Fitted to the labelled documents that are not held out."""
    sample = samples.labelled_sample(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic",
        max_rows=TOXIC_ROWS, allowed=~held_out("doc_id"))
    return toxicity.train(sample)


def held_out(key: str) -> Column:
    """Whether a row's key puts it aside; a NULL key counts as an empty one, which does not."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every whole text."""
    machine = toxicity_machine(spark, sf_dir)
    scored = toxicity.score(table(spark, sf_dir, "documents"), machine, keep=["doc_id"])
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of near duplicates of every document."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every whole text shares with the items of the benchmark, ten words or more."""
    found = decontamination.find_matches(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the leading components of all distinct ones, whitened."""
    vectors = whitening.usual_length(table(spark, sf_dir, "embeddings").select(
        "vec_id", whitening.scaled_entries(F.col("embedding")).alias("x")))
    return whitening.whiten(vectors, whitening.fit_whitening(vectors))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the whole texts that occur three times, with their near words and forms."""
    return spelling.spelling_variants(spelling.count_words(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_quality_rules": op2_quality_rules,
    "op3_top_inner_products": op3_top_inner_products,
    "op4_mix_sources": op4_mix_sources,
    "op5_training_order": op5_training_order,
    "op6_pii_surrogates": op6_pii_surrogates,
    "op7_edited_counts": op7_edited_counts,
    "op8_shard_by_bytes": op8_shard_by_bytes,
    "op9_toxicity": op9_toxicity,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_decontamination": op11_decontamination,
    "op12_whitening": op12_whitening,
    "op13_spelling_variants": op13_spelling_variants,
}

_WEIGHT = "CASE source " + " ".join(
    f"WHEN '{name}' THEN {weight:e}" for name, weight in MIX_WEIGHTS.items()) + " ELSE 1e0 END"

ORACLE = {
    "op3_top_inner_products": """
WITH vectors AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
  FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
    "op4_mix_sources": f"""
WITH sizes AS (
  SELECT source, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS bytes FROM documents GROUP BY source),
weighed AS (SELECT source, bytes, {_WEIGHT} AS weight FROM sizes),
rates AS (
  SELECT source, weight / (SELECT sum(weight) FROM weighed)
    * (SELECT sum(bytes) FROM sizes)::DOUBLE / bytes AS rate FROM weighed),
parts AS (SELECT source, rate, greatest(ceil(rate / {mixing.CHUNK}), 1)::BIGINT AS n FROM rates),
terms AS (
  SELECT source, n, k, exp(k * ln(rate / n) - rate / n - lgamma(k + 1)) AS p
  FROM parts, range({mixing.STEPS}) s(k) WHERE rate > 0),
cdf AS (SELECT source, n, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
dist AS (SELECT source, n, list(c ORDER BY k) AS cdf FROM cdf GROUP BY source, n),
drawn AS (
  SELECT d.*, list_sum(list_transform(range(n), lambda j: len(list_filter(cdf, lambda c:
    c <= ('0x' || substr(md5('{MIX_SEED}|draw|' || j || '|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT
         / {float(2 ** mixing.BITS)!r}::DOUBLE))))::BIGINT AS times
  FROM documents d JOIN dist ON d.source IS NOT DISTINCT FROM dist.source),
copies AS (SELECT * EXCLUDE times, unnest(range(times))::INT AS copy_no FROM drawn)
SELECT doc_id, text, lang, source, n_chars, copy_no,
  ('0x' || substr(md5('{MIX_SEED}|order|' || copy_no || '|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT
    AS mix_key
FROM copies""",
    "op8_shard_by_bytes": f"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8),
steps AS (SELECT list(c::BIGINT ORDER BY i) AS t FROM bits WHERE k = 8),
parts AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: ('0x' || p)::BIGINT) AS v
  FROM documents),
crcs AS (
  SELECT doc_id, size::BIGINT AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, v),
    lambda c, y: xor(c // 256, t[xor(c % 256, y) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM parts, steps),
placed AS (
  SELECT *, row_number() OVER w AS row, (sum(size) OVER w)::HUGEINT AS ends,
    (sum(size) OVER ())::HUGEINT AS total
  FROM crcs
  WINDOW w AS (ORDER BY text_crc32 NULLS FIRST, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)),
cut AS (SELECT *, least({SHARDS - 1}, (2 * ends - size) * {SHARDS} // (2 * total))::INT AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  row - min(row) OVER (PARTITION BY shard) AS slot, NULL::INT AS grown_shard
FROM cut""",
    "op10_near_duplicates": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 75 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(b) AS component_id,
  d.doc_id = min(b) AS kept
FROM documents d JOIN reach ON a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op11_decontamination": r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (
    SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i
    FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n),
found AS (
  SELECT p.r, p.i, p.n, v.item_id FROM places p JOIN windows v
  ON v.n = p.n AND array_to_string(p.w[p.i:p.i + p.n - 1], ' ') = v.g),
hits AS (
  SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS place FROM found) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS listed
  FROM (SELECT DISTINCT r, coalesce(item_id::VARCHAR, '') AS id FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)""",
    "op13_spelling_variants": r"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8),
steps AS (SELECT list(c::BIGINT ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[a-z\x{C0}-\x{FF}]+')) AS run
  FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
      regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '..'), lambda p: ('0x' || p)::BIGINT)),
    lambda c, y: xor(c // 256, t[xor(c % 256, y) + 1])), 4294967295::BIGINT) AS h
  FROM counted, steps),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run) + 2)::BIGINT)
      ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
skips AS (
  SELECT word, n, left(word, i - 1) || substr(word, i + 1) AS short, left(word, i - 1) || '.' || substr(word, i + 1) AS skip
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM skips a JOIN skips b ON a.skip = b.skip AND a.word <> b.word
  UNION
  SELECT s.word, w.word, w.n FROM skips s JOIN words w ON s.short = w.word
  UNION
  SELECT w.word, s.word, s.n FROM skips s JOIN words w ON s.short = w.word),
best AS (
  SELECT word, count(*) AS n_near, max(m) AS most, arg_min(other, (-m, encode(other))) AS form FROM near GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near,
    CASE WHEN most >= 2 * w.n THEN form END AS form, CASE WHEN most >= 2 * w.n THEN most END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
ways AS (
  SELECT word, word AS root, 0 AS steps FROM words
  UNION ALL
  SELECT y.word, f.form, y.steps + 1 FROM ways y JOIN formed f ON f.word = y.root WHERE f.form IS NOT NULL),
lasts AS (SELECT word, arg_max(root, steps) AS root FROM ways GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n::BIGINT AS form_n FROM formed f JOIN lasts l ON l.word = f.word""",
}
