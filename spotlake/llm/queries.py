"""The registered queries of this subpackage: thin reads of an operator's result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlake.llm import byte_bpe, chat, gam, license_scan, multi_index, packing, periodic_runs, pii, quality_rules, simhash, spelling, token_count, topk
from spotlake.llm.common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Whoever holds the key can link surrogates to entities; a deployment passes its own.
SURROGATE_KEY = "spotlake surrogates"


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(table(spark, sf_dir, "documents"), SURROGATE_KEY)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = table(spark, sf_dir, "labels").where(~gam.held_out())
    return gam.classify(docs, learn).select("doc_id", gam.held_out().alias("held_out"), "score", "predicted")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    back = chat.read_back(chat.format_windows(chats.unionByName(control)))
    whole = back.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "turns", "targets"))).alias("w"), F.sum("chars").cast("long").alias("formatted_chars"))
    turns, targets = F.flatten(F.col("w.turns")), F.array_join(F.flatten(F.col("w.targets")), "")
    text = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length(targets).cast("long").alias("loss_chars"),
        F.sha2(targets, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = byte_bpe.encode(docs, path, public_tokenizers.PATTERN, decoded_col="decoded")
    return ids.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors, F.col("id") % 100 == 0, 10)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality_rules.apply_rules(docs).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op11_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")).select("vec_id", "n_links", "component_id", "kept")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), change=periodic_runs.repeated_from)
    # greatest length/period by cross products, then smallest start and period
    step = lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b)
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    text = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.aggregate("runs", none, step).alias("best"), text.alias("told"), "collapsed")
    milli = F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long")
    return told.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), F.sha2("told", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents").select("doc_id", "text"), slip=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_simhash": op2_simhash,
    "op3_pii": op3_pii,
    "op4_license_scan": op4_license_scan,
    "op5_quality": op5_quality,
    "op6_chat": op6_chat,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_topk": op8_topk,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_count": op10_token_count,
    "op11_multi_index": op11_multi_index,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_spelling_variants": op13_spelling_variants,
}

#: The crc32 of a list of bytes, by the table of its polynomial.
_CRC_TABLE = "list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END))"
_BYTES = "flatten(list_transform(string_split({0}, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [195, ord(c) - 64] END))"
_CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>|\|)"
#: Lengths of a turn's parts, its place and tokens, then stretches of half the room, long last turns apart, and what windows repeat.
ORACLES: dict[str, str] = {
    "op6_chat": rf"""
        WITH c AS (
          SELECT coalesce('=' || CAST(conv_id AS VARCHAR), '') AS conv, conv_id, coalesce(CAST(turn AS BIGINT), -4611686018427387904) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT '=-7', -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT '=-7', -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        t AS (
          SELECT *, len(regexp_extract_all(text, '\p{{L}}{{1,6}}|[^ \t\n\x0B\f\r\p{{L}}]')) + 4 AS tokens,
            length(regexp_replace(text, '{_CONTROL}', '\1\\\2\3', 'g')) + length(regexp_replace(replace(replace(role, '\', '\b'), chr(10), '\n'), '{_CONTROL}', '\1\\\2\3', 'g')) + 9 AS size
          FROM c),
        p AS (
          SELECT *, row_number() OVER w - 1 AS place, coalesce(sum(tokens) OVER (PARTITION BY conv ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prefix
          FROM t WINDOW w AS (PARTITION BY conv ORDER BY turn, role, text)),
        s AS (SELECT conv, tokens AS st, size AS system_size FROM p WHERE place = 0 AND role = 'system'),
        r AS (SELECT p.*, st, system_size, CASE WHEN coalesce(st, 0) <= 512 THEN 1024 - coalesce(st, 0) ELSE 1024 END AS room FROM p LEFT JOIN s USING (conv)),
        b AS (SELECT *, CAST(floor(prefix / floor(room / 2)) AS BIGINT) AS stretch FROM r),
        o AS (SELECT *, sum(tokens) OVER (PARTITION BY conv, stretch) > CASE WHEN stretch = 0 THEN 1024 ELSE room END AND place = max(place) OVER (PARTITION BY conv, stretch) AS apart FROM b),
        x AS (SELECT *, stretch * 2 + CASE WHEN apart THEN 1 ELSE 0 END AS win FROM o),
        v AS (SELECT conv, win, min(place) AS first, sum(tokens) AS own, max(st) AS st, max(system_size) AS system_size FROM x GROUP BY conv, win),
        l AS (SELECT *, coalesce(win > 0 AND (own + st <= 1024 OR own > 1024), false) AS led FROM v),
        h AS (
          SELECT l.conv, l.win, x.size, sum(x.tokens) OVER (PARTITION BY l.conv, l.win ORDER BY k.h) AS run, 1024 - own - CASE WHEN led THEN l.st ELSE 0 END AS left_over
          FROM l, (VALUES (1), (2)) AS k(h), x WHERE x.conv = l.conv AND x.place = l.first - k.h AND l.win > 0 AND l.first - k.h >= CASE WHEN led THEN 1 ELSE 0 END),
        n AS (SELECT conv, sum(size) AS size FROM (SELECT conv, size FROM x UNION ALL SELECT conv, size FROM h WHERE run <= left_over UNION ALL SELECT conv, system_size FROM l WHERE led) GROUP BY conv),
        g AS (
          SELECT conv, any_value(conv_id) AS conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY place) AS whole,
            coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '') AS loss FROM p GROUP BY conv)
        SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(size AS BIGINT) AS formatted_chars FROM g JOIN n USING (conv)""",
    "op11_multi_index": """
        WITH RECURSIVE u AS MATERIALIZED (
          SELECT row_number() OVER () AS rn, vec_id, label, embedding::DOUBLE[] AS v,
            coalesce(label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS sound FROM embeddings),
        l AS MATERIALIZED (SELECT a.rn AS x, b.rn AS y FROM u a JOIN u b ON a.sound AND b.sound AND a.label = b.label AND a.rn <> b.rn AND list_cosine_similarity(a.v, b.v) >= 0.93),
        r AS (SELECT rn AS x, rn AS y FROM u UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
        c AS (SELECT r.x, min(u.vec_id) AS component_id FROM r JOIN u ON u.rn = r.y GROUP BY r.x),
        n AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM u JOIN c ON c.x = rn LEFT JOIN n ON n.x = rn""",
    "op12_periodic_runs": f"""
        WITH tab AS MATERIALIZED (SELECT {_CRC_TABLE} AS t),
        d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+') AS w,
          xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {_BYTES.format("coalesce(CAST(doc_id AS VARCHAR), '')")}::BIGINT[]), lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8))) AS h FROM documents, tab),
        g AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS changed, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, (h // 10) % 8 AS m FROM d),
        p AS (SELECT *, 1 + (n - a) // (3 + m) AS p FROM g),
        x AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, n, CASE WHEN changed THEN list_transform(range(0, n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM p),
        q AS MATERIALIZED (SELECT k, n, CAST(unnest(range(0, n)) AS BIGINT) AS i, unnest(w) AS word FROM x),
        e AS (SELECT a.k, a.i, b.i - a.i AS q FROM q a JOIN q b ON a.k = b.k AND a.word = b.word AND b.i > a.i AND 3 * (b.i - a.i) <= a.n),
        s AS (SELECT k, q, min(i) AS start, count(*) + q AS length FROM (SELECT k, q, i, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS island FROM e) GROUP BY k, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
        r AS MATERIALIZED (SELECT k, start, length, min(q) AS period FROM s GROUP BY k, start, length),
        t AS (SELECT k, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS told FROM r GROUP BY k),
        b AS (SELECT k, start, length, period FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY length / CAST(period AS DOUBLE) DESC, start, period) AS rn FROM r) WHERE rn = 1),
        z AS (SELECT q.k, string_agg(word, ' ' ORDER BY i) AS kept FROM q LEFT JOIN (SELECT DISTINCT k, unnest(range(start + period, start + length)) AS i FROM r) o USING (k, i) WHERE o.k IS NULL GROUP BY q.k)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
        FROM x LEFT JOIN t USING (k) LEFT JOIN b USING (k) LEFT JOIN z USING (k)""",
    "op13_spelling_variants": f"""
        WITH RECURSIVE tab AS MATERIALIZED (SELECT {_CRC_TABLE} AS t),
        runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS w FROM documents),
        low AS (SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM runs WHERE length(w) >= 5 GROUP BY ALL),
        hashed AS (
          SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {_BYTES.format("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w")}::BIGINT[]), lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8))) AS h FROM low, tab),
        slipped AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, n FROM hashed),
        v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        gaps AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS gap FROM (SELECT word, n, CAST(unnest(range(0, length(word))) AS BIGINT) AS i FROM v)),
        near AS MATERIALIZED (
          SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b ON a.gap = b.gap AND a.i = b.i AND a.word <> b.word AND length(a.word) = length(b.word)
          UNION SELECT g.word, v.word, v.n FROM gaps g JOIN v ON g.gap = v.word UNION SELECT v.word, g.word, g.n FROM gaps g JOIN v ON g.gap = v.word),
        best AS (SELECT word, count(*) AS n_near, arg_min(other, {{'n': -other_n, 'w': other}}) AS form, max(other_n) AS form_n FROM near GROUP BY word),
        formed AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * v.n THEN form END AS form, CASE WHEN form_n >= 2 * v.n THEN form_n END AS form_n FROM v LEFT JOIN best USING (word)),
        way AS (SELECT word, word AS root FROM formed UNION ALL SELECT way.word, f.form FROM way JOIN formed f ON f.word = way.root AND f.form IS NOT NULL)
        SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM formed f JOIN (SELECT word, root FROM way JOIN (SELECT word AS root FROM formed WHERE form IS NULL) USING (root)) w ON w.word = f.word""",
    "op8_topk": """
        WITH usable AS MATERIALIZED (
          SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
          SELECT q.rn AS key, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
          FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND c.rn <> q.rn),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, vec_id) AS rank FROM scored)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10""",
}
