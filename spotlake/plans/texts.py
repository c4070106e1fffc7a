"""Queries over words, calls and lines: words of documents stand for decoded words, benchmark texts for truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlake.functions import text as T
from spotlake.plans.registry import EVENTS, events, query, table


def _words(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """Distinct words of ASCII letters and digits, in upper case."""
    return table(spark, sf_dir, name).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0))).alias("word")).select(F.upper("word").alias("word")).distinct()


def _sql_words(name: str) -> str:
    return f"(SELECT DISTINCT upper(w) AS word FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS w FROM {name}))"


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls made of events: a letter pair from the user, a digit from k, letters from the type."""
    letter = lambda n: F.char(F.lit(65) + (n % 26).cast("int"))
    call = F.concat(letter(F.col("user_id")), letter(F.floor(F.col("user_id") / 26)), (F.col("k") % 10).cast("string"), F.upper(F.substring("event_type", 1, 3)), F.when(F.col("k") % 7 == 0, "/P").otherwise(""))
    return events(spark, sf_dir).withColumn("call", call)


_CALLS = f"{EVENTS}, c AS (SELECT *, chr(65 + CAST(user_id % 26 AS INTEGER)) || chr(65 + CAST((user_id // 26) % 26 AS INTEGER)) || CAST(k % 10 AS VARCHAR) || upper(substr(event_type, 1, 3)) || CASE WHEN k % 7 = 0 THEN '/P' ELSE '' END AS call FROM ev)"


@query(f"""SELECT word, coalesce(regexp_matches(word, '^[A-Z0-9]{{2,6}}[A-Z]$') AND regexp_matches(word, '[0-9]') AND regexp_matches(word, '[A-Z]')
  AND word NOT IN ('5NN', '4NN', '3NN', '599', 'TEST', 'TU', 'QRZ', 'AGN', 'K', 'KN'), false) AS plausible FROM {_sql_words('documents')}""")
def plausible_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select("word", T.is_plausible(F.col("word")).alias("plausible"))


_KEPT = "CASE WHEN regexp_matches(b, '^[A-Z][0-9][A-Z]') THEN 2 WHEN regexp_matches(b, '^[0-9][A-Z][A-Z]') THEN 4 ELSE 3 END"
_PATTERNS = f"{_CALLS}, pc AS (SELECT *, substr(b, 1, {_KEPT}) || regexp_replace(regexp_replace(substr(b, {_KEPT} + 1), '[A-Z]', '@', 'g'), '[0-9]', '#', 'g') AS pattern FROM (SELECT *, upper(split_part(call, '/', 1)) AS b FROM c))"


@query(f"WITH {_PATTERNS} SELECT pattern, count(DISTINCT call) AS calls, CASE WHEN count(DISTINCT call) >= 2 THEN 'common' ELSE 'listed' END AS tier FROM pc GROUP BY pattern")
def derive_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _calls(spark, sf_dir).select("call", T.pattern_of(F.col("call")).alias("pattern"))
    found = calls.groupBy("pattern").agg(F.countDistinct("call").alias("calls"))
    return found.withColumn("tier", F.when(F.col("calls") >= 2, "common").otherwise("listed"))


@query(f"""WITH {_PATTERNS}, p AS (SELECT pattern, count(DISTINCT call) AS n FROM pc WHERE event_type = 'purchase' GROUP BY 1)
  SELECT tier, CAST(CASE tier WHEN 'common' THEN 2 WHEN 'listed' THEN 3 ELSE 5 END AS INTEGER) AS required, count(*) AS rows FROM
  (SELECT CASE WHEN p.n >= 2 THEN 'common' WHEN p.n = 1 THEN 'listed' ELSE 'unlisted' END AS tier FROM pc LEFT JOIN p USING (pattern)) GROUP BY ALL""")
def pattern_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _calls(spark, sf_dir).select("call", "event_type", T.pattern_of(F.col("call")).alias("pattern"))
    listed = calls.where("event_type = 'purchase'").groupBy("pattern").agg(F.countDistinct("call").alias("n"))
    tier = F.when(F.col("n") >= 2, "common").when(F.col("n") == 1, "listed").otherwise("unlisted")
    return calls.join(listed, "pattern", "left").groupBy(tier.alias("tier")).agg(F.count("*").alias("rows")).withColumn("required", T.required_reps(F.col("tier")))


@query(f"""WITH w AS (SELECT word FROM {_sql_words('benchmark')})
  SELECT a.word AS a, b.word AS b, CASE WHEN contains(a.word, b.word) OR contains(b.word, a.word) THEN 'contains' ELSE 'similar' END AS relation
  FROM w a JOIN w b ON a.word < b.word WHERE contains(a.word, b.word) OR contains(b.word, a.word)
  OR (length(a.word) >= 3 AND length(b.word) >= 3 AND substr(a.word, 1, 3) = substr(b.word, 1, 3) AND levenshtein(a.word, b.word) <= 2)""")
def variant_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar words share a head; a word within another is one of its substrings, whatever the heads."""
    words = _words(spark, sf_dir, "benchmark").withColumn("head", F.substring("word", 1, 3))
    pairs = words.select("head", F.col("word").alias("a")).join(words.select("head", F.col("word").alias("b")), "head").where("a < b")
    similar = pairs.select("a", "b", T.variant_relation(F.col("a"), F.col("b")).alias("relation")).where("relation = 'similar'")
    size, places = F.length("word"), F.sequence(F.lit(1), F.length("word"))
    parts = F.array_distinct(F.flatten(F.transform(places, lambda i: F.transform(F.sequence(F.lit(1), size - i + 1), lambda n: F.substring("word", i, n)))))
    held = words.select(F.col("word").alias("whole"), F.explode(parts).alias("word")).where("word <> whole").join(words, "word")
    return similar.unionByName(held.select(F.least("word", "whole").alias("a"), F.greatest("word", "whole").alias("b"), F.lit("contains").alias("relation")))


_ASCII = "[^ -~]"


@query(f"""WITH b AS (SELECT item_id, upper(regexp_replace(text, '{_ASCII}', '', 'g')) AS e FROM benchmark), d AS (SELECT doc_id % (SELECT count(*) FROM benchmark) AS item_id, upper(regexp_replace(text, '{_ASCII}', '', 'g')) AS x FROM documents),
  n AS (SELECT item_id, trim(regexp_replace(e, '\\s+', ' ', 'g')) AS e, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS x FROM b JOIN d USING (item_id)), r AS (SELECT item_id, levenshtein(e, x) / greatest(length(e), 1) AS rate FROM n)
  SELECT item_id, count(*) AS n, round(avg(rate), 6) AS cer_mean, count(*) FILTER (rate < 0.1) AS good FROM r GROUP BY item_id""")
def error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts; documents are dealt over all items."""
    plain = F.regexp_replace("text", _ASCII, "")
    items = table(spark, sf_dir, "benchmark")
    truth = items.select("item_id", plain.alias("expected"))
    count = F.broadcast(items.agg(F.count("*").alias("items")))
    decoded = table(spark, sf_dir, "documents").crossJoin(count).select((F.col("doc_id") % F.col("items")).alias("item_id"), plain.alias("decoded"))
    rated = truth.join(decoded, "item_id").select("item_id", T.character_error_rate(F.col("expected"), F.col("decoded")).alias("rate"))
    return rated.groupBy("item_id").agg(F.count("*").alias("n"), F.round(F.avg("rate"), 6).alias("cer_mean"), F.count_if(F.col("rate") < 0.1).alias("good"))


@query(f"""WITH {_CALLS}, h AS (SELECT event_id, call, k, 'DX de W' || CAST(user_id AS VARCHAR) || '-#:' AS head, printf('%.2f', 7000 + value) AS f, lpad(CAST((t // 3600000000) % 24 AS VARCHAR), 2, '0') || lpad(CAST((t // 60000000) % 60 AS VARCHAR), 2, '0') AS hm FROM c),
  l AS (SELECT *, head || lpad(f, CAST(greatest(length(f) + 1, 24 - length(head)) AS INTEGER), ' ') || '  ' AS l1 FROM h)
  SELECT event_id, rpad(l1 || call, CAST(greatest(41, length(l1) + length(call) + 1) AS INTEGER), ' ') || 'CW   ' || lpad(CAST(k AS VARCHAR), 3, ' ') || ' dB ' || lpad(CAST(k % 40 AS VARCHAR), 3, ' ') || ' WPM ' || 'CQ     ' || hm || 'Z' AS line FROM l""")
def wire_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = F.concat(F.lpad((F.floor(F.col("t") / 3_600_000_000) % 24).cast("string"), 2, "0"), F.lpad((F.floor(F.col("t") / 60_000_000) % 60).cast("string"), 2, "0"))
    line = T.dx_line(F.concat(F.lit("W"), F.col("user_id").cast("string")), 7000 + F.col("value"), F.col("call"), F.lit("CW"), F.col("k"), F.col("k") % 40, F.lit("CQ"), minutes)
    return _calls(spark, sf_dir).select("event_id", line.alias("line"))


@query("""WITH p AS (SELECT c_custkey, (c_custkey * 7919 % 18000) / 100.0 - 90 AS lat, (c_custkey * 104729 % 36000) / 100.0 - 180 AS lon FROM customer)
  SELECT c_custkey, chr(65 + CAST(floor((lon + 180) / 20) AS INTEGER)) || chr(65 + CAST(floor((lat + 90) / 10) AS INTEGER)) || CAST(CAST(floor(((lon + 180) % 20.0) / 2) AS BIGINT) AS VARCHAR) || CAST(CAST(floor((lat + 90) % 10.0) AS BIGINT) AS VARCHAR)
  || chr(97 + CAST(floor(((lon + 180) % 2.0) * 12) AS INTEGER)) || chr(97 + CAST(floor(((lat + 90) % 1.0) * 24) AS INTEGER)) AS grid FROM (SELECT c_custkey, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM p)""")
def locator_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    lat, lon = (key * 7919 % 18000) / F.lit(100.0) - 90, (key * 104729 % 36000) / F.lit(100.0) - 180
    return table(spark, sf_dir, "customer").select("c_custkey", T.locator(lat, lon).alias("grid"))


@query("""SELECT conv_id, count(*) AS turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id""")
def text_from_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.col("role"), F.lit(": "), F.col("text"))
    parts = F.sort_array(F.collect_list(F.struct("turn", line.alias("line"))))
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), parts.alias("parts"))
    return grouped.select("conv_id", "turns", F.array_join(F.col("parts.line"), "\n").alias("text"))


@query("SELECT conv_id, CAST(max(turn) AS BIGINT) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max_by(F.struct("role", "text"), "turn").alias("last")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").cast("long").alias("turn"), last).select("conv_id", "turn", "last.role", "last.text")


@query(f"WITH {_CALLS} SELECT event_id, regexp_replace(call, '/P$', '') AS base, upper(trim(' ' || lower(call) || ' ')) AS spotter, CAST(CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS INTEGER) AS portable FROM c")
def spotter_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" "), F.lower("call"), F.lit("-# "))
    suffix = F.when(F.contains("call", F.lit("/")), F.substring_index("call", "/", -1)).otherwise("")
    return _calls(spark, sf_dir).select("event_id", F.substring_index("call", "/", 1).alias("base"), T.normal_spotter(raw).alias("spotter"), T.is_portable(suffix).cast("int").alias("portable"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]+')) AS words, coalesce(nullif(regexp_extract(text, '([0-9]+)[^0-9]*$', 1), ''), NULL) AS last_number FROM documents""")
def last_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))
    last = F.when(F.size(numbers) > 0, F.element_at(numbers, -1))
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit("[A-Za-z]+")).cast("long").alias("words"), last.alias("last_number"))
