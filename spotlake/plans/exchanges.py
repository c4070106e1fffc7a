"""Queries of the exchange grammar: events as words of the operators on a frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlake.functions.text import CONVENTIONS
from spotlake.operators import interpreter
from spotlake.plans.registry import EVENTS, events, query

#: Words by the events' number; the others are calls, few of them and often repeated.
_WORDS = ("CQ", "test", "DE", "UP", "V", "TU", "5NN", "?", "EEEEE", "K", "WPX", "QRZ", "hello", "T", "007")
_PLAUSIBLE = r"'^[A-Z0-9]{2,6}[A-Z](/(P|QRP|MM|AM|M|[0-9]))?$'"


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, u = F.col("k"), F.col("user_id")
    word = F.get(F.array(*[F.lit(w) for w in _WORDS]), F.floor(k / 2).cast("int"))
    call = F.concat(F.lit("k"), (u % 3 + F.floor(k / 90)).cast("string"), F.lit("AB"), F.when(k % 10 == 7, "/P").otherwise(""))
    rows = events(spark, sf_dir).withColumn("word", F.coalesce(word, call))
    return rows.withColumn("ends", (F.col("event_type") == "signup") & (k % 4 == 0)).withColumn("bad", (F.col("event_type") == "error") & (k % 3 == 0))


def _listed(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _plausible(w: str) -> str:
    base = f"split_part({w}, '/', 1)"
    return f"(regexp_matches({w}, {_PLAUSIBLE}) AND regexp_matches({base}, '[0-9]') AND regexp_matches({base}, '[A-Z]') AND {base} NOT IN {_listed(CONVENTIONS)})"


def _verdict(role: str, frame: str, basis: str, end: str) -> str:
    return f"{{'role': '{role}', 'frame': {frame}, 'basis': {basis}, 'span_end': {end}}}"


_PARTING = lambda p: f"coalesce(({p}.w <> w AND {_plausible(p + '.w')}) OR {p}.w IN {_listed(interpreter.SIGN_OFFS)}, false)"
_SELF = _verdict("self", "CASE WHEN back IN ('de cq', 'cq', 'test') THEN 'cq' ELSE back END", "CASE WHEN back IN ('de', 'de cq') THEN 'after_de' WHEN back = 'beacon' THEN 'preamble' ELSE 'after_' || back END", "CASE WHEN aft = 'cq' THEN nxt ELSE b + 1 END")
_SIGNING, _CALLED = _verdict("self", "'signoff'", "'after_signoff'", "b + 1"), _verdict("addressee", "NULL::VARCHAR", "'before_de'", "nxt")
_KIND = (
    f"CASE WHEN w IN {_listed(interpreter.TURN_ENDS)} THEN 'end' " + " ".join(f"WHEN w = '{n}' THEN '{c}'" for n, c in interpreter.NAMED.items())
    + f" WHEN w IN {_listed(interpreter.QUERIES)} THEN 'query' WHEN w IN {_listed(interpreter.FILLERS)} THEN 'filler' WHEN w IN {_listed(interpreter.SIGN_OFFS)} THEN 'signoff'"
    + " WHEN regexp_matches(w, '^[1-5][1-9N][1-9N]$') THEN 'report' WHEN regexp_matches(w, '^[0-9TN]{1,4}$') AND regexp_matches(w, '[0-9]') THEN 'serial' WHEN regexp_matches(w, '^Q[A-Z]{2}\\??$') THEN 'qcode'"
    + f" WHEN regexp_matches(w, '^E{{5,}}$') THEN 'correction' WHEN regexp_matches(w, '^[A-Z0-9/]{{3,15}}$') AND split_part(w, '/', 1) NOT IN {_listed(CONVENTIONS)} THEN 'call' ELSE 'other' END"
)
_WORD = f"""upper(coalesce([{", ".join(f"'{w}'" for w in _WORDS)}][CAST(k // 2 AS INTEGER) + 1], 'k' || CAST(user_id % 3 + k // 90 AS VARCHAR) || 'AB' || CASE WHEN k % 10 = 7 THEN '/P' ELSE '' END))"""


def _roles(spoken: str) -> str:
    """rl: the roles of the calls in sp (key, event_id, w, ends, bad), which is `spoken`."""
    return f"""{EVENTS}, sp AS ({spoken}), kd AS (SELECT *, {_KIND} AS kind, row_number() OVER (PARTITION BY key ORDER BY event_id) - 1 AS wi FROM sp),
  tn AS (SELECT *, coalesce(sum(CASE WHEN ends OR kind = 'end' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY wi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn,
    CASE WHEN kind IN ('cq', 'test', 'filler') THEN 'frame' WHEN kind = 'v' THEN 'v' WHEN kind = 'call' THEN 'call ' || w END AS g FROM kd),
  op AS (SELECT *, g IS NULL OR coalesce(g <> lag(g) OVER t, true) OR (kind = 'call' AND coalesce(lag(bad) OVER t, false)) AS opens FROM tn WINDOW t AS (PARTITION BY key, turn ORDER BY wi)),
  nr AS (SELECT *, sum(opens::INTEGER) OVER (PARTITION BY key, turn ORDER BY wi ROWS UNBOUNDED PRECEDING) AS seg FROM op),
  sg AS (SELECT key, turn, seg, CASE WHEN min(g) = 'frame' THEN 'frame' ELSE min(kind) END AS kind, min(wi) AS a, max(wi) AS b, count(*) AS n, arg_max(w, wi) AS w, arg_max(bad, wi) AS bad, arg_max(ends, wi) AS ends,
    bool_or(kind = 'cq') AS has_cq, arg_min(kind, wi) = 'test' AS tests, arg_min(kind, wi) AS first FROM nr GROUP BY key, turn, seg),
  st AS (SELECT *, {{'kind': kind, 'a': a, 'b': b, 'n': n, 'w': w, 'bad': bad, 'has_cq': has_cq, 'tests': tests}} AS s FROM sg),
  lg AS (SELECT *, {", ".join(f"lag(s, {i}) OVER t AS p{i}" for i in range(1, 6))}, CASE WHEN ends THEN 'end' ELSE coalesce(lead(first) OVER t, '') END AS aft, NOT ends AND lead(first) OVER t IS NOT NULL AS followed
    FROM st WINDOW t AS (PARTITION BY key, turn ORDER BY seg)),
  sk AS (SELECT *, CASE WHEN p1.kind = 'correction' THEN CASE WHEN p2.kind = 'call' THEN 2 ELSE 1 END WHEN p1.kind = 'call' AND p1.bad THEN 1 ELSE 0 END AS skip FROM lg WHERE kind = 'call'),
  ef AS (SELECT *, CASE skip WHEN 2 THEN p3 WHEN 1 THEN p2 ELSE p1 END AS e, CASE skip WHEN 2 THEN p4 WHEN 1 THEN p3 ELSE p2 END AS eb, CASE skip WHEN 2 THEN p5 WHEN 1 THEN p4 ELSE p3 END AS ebb FROM sk),
  ld AS (SELECT *, coalesce(eb.kind = 'frame' AND (eb.has_cq OR (eb.tests AND NOT {_PARTING("ebb")})), false) AS led, b + CASE WHEN followed THEN 2 ELSE 1 END AS nxt FROM ef),
  bk AS (SELECT *, CASE WHEN e.kind = 'de' AND (led OR aft = 'cq') THEN 'de cq' WHEN e.kind = 'de' THEN 'de' WHEN e.kind = 'frame' AND e.has_cq THEN 'cq' WHEN e.kind = 'frame' AND e.tests THEN CASE WHEN {_PARTING("eb")} THEN 'parting test' ELSE 'test' END
      WHEN e.kind = 'v' AND e.n >= 3 THEN 'beacon' WHEN e.kind = 'signoff' THEN 'signoff' END AS back,
    CASE WHEN e.kind = 'de' AND led THEN eb.a WHEN e.kind IN ('de', 'frame', 'signoff') THEN e.a WHEN e.kind = 'v' AND e.n >= 3 THEN e.b - 2 ELSE a END AS span_start FROM ld),
  fr AS (SELECT *, coalesce(back IN ('de cq', 'de', 'cq', 'test', 'beacon'), false) AS framed FROM bk),
  ru AS (SELECT *, CASE WHEN aft = 'correction' OR bad THEN {_verdict("uncertain", "NULL::VARCHAR", "'corrected'", "nxt")} WHEN aft = 'de' THEN {_CALLED} WHEN framed THEN {_SELF}
      WHEN back = 'parting test' THEN {_verdict("uncertain", "NULL::VARCHAR", "'parting_test'", "b + 1")} WHEN aft = 'up' THEN {_verdict("self", "'up'", "'before_up'", "nxt")}
      WHEN aft IN ('report', 'serial') THEN {_verdict("addressee", "NULL::VARCHAR", "'before_report'", "nxt")} WHEN aft = 'query' THEN {_verdict("addressee", "NULL::VARCHAR", "'before_query'", "nxt")} WHEN back = 'signoff' THEN {_SIGNING} END AS last_is FROM fr),
  ot AS (SELECT *, CASE WHEN NOT (aft = 'correction' OR bad) AND aft = 'de' THEN CASE WHEN framed THEN {_SELF} WHEN back = 'signoff' THEN {_SIGNING} ELSE {_CALLED} END ELSE last_is END AS others_are FROM ru),
  ow AS (SELECT *, CASE WHEN {_plausible("w")} AND (coalesce(last_is.role = 'self', false) OR (n > 1 AND coalesce(others_are.role = 'self', false))) THEN w END AS own FROM ot),
  nm AS (SELECT *, coalesce(min(own) OVER t <> w OR max(own) OVER t <> w, false) AS named FROM ow WINDOW t AS (PARTITION BY key, turn ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  ea AS (SELECT key, w, unnest(range(a, b + 1)) AS place, b, span_start, followed OR ends AS settled, last_is, others_are, CASE WHEN named THEN {_verdict("mention", "NULL::VARCHAR", "'mention_in_turn'", "b + 1")} ELSE {_verdict("uncertain", "NULL::VARCHAR", "'no_frame'", "b + 1")} END AS rest FROM nm),
  rl AS (SELECT key, place, w AS call, settled, span_start, unnest(coalesce(CASE WHEN place = b THEN last_is ELSE others_are END, rest)) FROM ea)"""


@query(f"""WITH {_roles(f"SELECT user_id AS key, event_id, {_WORD} AS w, event_type = 'signup' AND k % 4 = 0 AS ends, event_type = 'error' AND k % 3 = 0 AS bad FROM ev")}
  SELECT key AS user_id, place, call, role, frame, basis, settled, span_start, span_end FROM rl""")
def exchange_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpreter.interpret(_spoken(spark, sf_dir), ["user_id"], "event_id", "word", "ends", "bad", complete=False)


@query(f"""WITH {_roles(f"SELECT CAST(user_id AS VARCHAR) || '-' || CAST(t // 7200000000 AS VARCHAR) AS key, event_id, {_WORD} AS w, false AS ends, false AS bad FROM ev")}, nx AS (SELECT key, w, row_number() OVER t - 1 AS place, lead(w) OVER t AS next, bool_or(w IN ('CQ', 'TEST', 'DE')) OVER (PARTITION BY key) AS framed FROM sp WINDOW t AS (PARTITION BY key ORDER BY event_id))
  SELECT key AS day_user, place, call, CASE WHEN frame = 'up' THEN 'de' ELSE frame END AS spot_type, span_start, span_end FROM rl WHERE role = 'self' AND frame <> 'signoff'
  UNION ALL SELECT key, place, regexp_extract(w, '([A-Z0-9/]{{3,15}})$', 1), 'beacon', place, place + 2 FROM nx WHERE next = 'T' AND NOT framed AND regexp_extract(w, '([A-Z0-9/]{{3,15}})$', 1) <> ''""")
def context_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of two hours of a user's words, each a complete exchange."""
    text = F.concat_ws("-", F.col("user_id").cast("string"), F.floor(F.col("t") / 7_200_000_000).cast("string"))
    return interpreter.context_matches(_spoken(spark, sf_dir).withColumn("day_user", text), ["day_user"], "event_id", "word")
