r"""Operator 3: surrogates for personal data, in DataFrame functions only.

Entities are found by one regex over the whole text and typed by form: e-mail addresses, phone numbers, IPv4 addresses, card
numbers, long hexadecimal secrets and keys, values of six or more characters named as a password, token or key, social security
numbers, and names after a title. In a text with a full name after a title, the same full name without one is an entity too. No
pattern has a longest entity, and repetitions are possessive, so that a text is searched in one go whatever it holds.

Each distinct entity, in a canonical form that is the same for its spellings (case of an address or of hexadecimal digits,
separators of a number), gets one surrogate from a keyed hash: addresses become addresses in a reserved domain, numbers numbers of
the same length and check digit, IPs addresses of the reserved block, keys and credentials strings with letters of the same case and
digits in the same places. Given names and surnames are entities of their own, by gender and script, so that a full name and its
surname alone stay one person; titles that say no gender (Dr, Prof) and untitled full names take the gender that their document's
other titles give the surname, if that is one. The surrogate is then written in the form of each occurrence (its separators,
its case, its title).

Coreference holds because the canonical form decides, distinctness because surrogates are checked: entities that drew the same
surrogate, or one that occurs in the corpus as an entity, draw again until none collides. From the fifth draw on, numbers gain
digits, credentials letters and IPs become long addresses, so there is always room, however dense the corpus.

A named value counts whole, however long. After `=` or a quote it is an entity whatever it holds; a bare value after a colon only with a
digit in it, for prose goes on there.

Occurrences are joined with the surrogates on the entity; entities that hold more than a thousandth of all occurrences are joined apart.

Null text stays null and has no entities. Rows are kept one by one, repeated rows and ids included; all columns are kept with
their order, those named as added columns are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotlake.llm.common import attach, cut, shielded, stored, unshielded

#: Title -> gender and script of the name after it; N: either.
TITLES = {
    "Mr": "M", "Mrs": "F", "Ms": "F", "Miss": "F", "Dr": "N", "Prof": "N", "Herr": "M", "Frau": "F", "Monsieur": "M", "Madame": "F", "Mme": "F",
    "Señor": "M", "Señora": "F", "Sr": "M", "Sra": "F", "Don": "M", "Doña": "F", "г-н": "M", "г-жа": "F", "κ.": "M", "κα": "F",
}
_TITLE = "|".join(sorted((t.replace(".", r"\.") for t in TITLES), key=lambda t: (-len(t), t)))
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
SECRET = r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|AKIA[0-9A-Z]{16,}+|gh[pousr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9]{20,}+)(?![A-Za-z0-9])"
_NAMED = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)"
#: A bare value holds neither = nor : inside, so that a search for its digit never runs past the next name.
_PLAIN = r"A-Za-z_+/.~!#$%^*?@-"
_VALUE = rf"[0-9{_PLAIN}]{{6,}}+={{0,2}}+"
#: What a quote holds up to white space or the next quote.
_QUOTED = r"[^\s\"']{6,}+"
CREDENTIAL = (
    rf"(?<={_NAMED}\s{{0,2}}[=:]\s{{0,2}}[\"']){_QUOTED}"
    rf"|(?:(?<={_NAMED}\s{{0,2}}(?:=|=\s{{1,2}}))|(?<={_NAMED}\s{{0,2}}:\s{{0,2}})(?=[{_PLAIN}]*+\d)){_VALUE}"
)
IPV4 = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"
SSN = r"(?<!\d)\d{3}-\d{2}-\d{4}(?![\d-])"
#: A number ends where its form does: what follows a blank may be an address or a card of its own.
PHONE = (
    r"\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
    r"|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?(?!\d{1,3}\.\d{1,3}\.)\d{2,4}){2,4}(?!\d)"
    r"|(?<![\d(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<!\d)\d{3}[.-]\d{3}[.-]\d{4}(?!\d)"
)
CARD = r"(?<![\d+])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)"
_WORD = r"\p{Lu}\p{L}++"
NAME = rf"(?<!\p{{L}})(?:{_TITLE})\.? {_WORD}(?: {_WORD})?+"
#: In this order: an earlier kind takes a place first.
KINDS = {"email": EMAIL, "secret": SECRET, "credential": CREDENTIAL, "ip": IPV4, "ssn": SSN, "phone": PHONE, "card": CARD, "name": NAME}
ENTITY = "|".join(f"(?:{p})" for p in KINDS.values())
_TITLED = rf"^(?:{_TITLE})\.? "
#: The form of a whole entity of a kind, once it stands alone without the name before it.
_ALONE = {k: p for k, p in KINDS.items() if k not in ("credential", "name")} | {"name": rf"(?:(?:{_TITLE})\.? )?+{_WORD}(?: {_WORD})|(?:{_TITLE})\.? {_WORD}", "credential": _QUOTED}
#: What every entity holds one of; a text without it is not searched.
PREFILTER = rf"\d|@|{_NAMED}\s{{0,2}}[=:]|[a-f]{{32}}|[A-F]{{32}}|AKIA|gh[pousr]_|sk-|(?<!\p{{L}})(?:{_TITLE})\.? \p{{Lu}}"

#: Syllables and endings that surrogate names are made of, by script; endings by gender (M, F, N).
SYLLABLES = {
    "latin": ("ba be bi bo da de di do fa fe fi ga ge ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so ta te ti to va ve vi".split(), {"M": "n", "F": "na", "N": "r"}),
    "cyrillic": ("ба бе бо ва ве ви га го да де до за зо ка ко ла ле ли ло ма ме ми на не ни но ра ре ри ро са се со та те ти".split(), {"M": "в", "F": "ва", "N": "к"}),
    "greek": ("βα βε βο γα γε δα δε δη κα κε κο λα λε λη μα με μη να νε νη ρα ρε ρη σα σε τα τε τη".split(), {"M": "ς", "F": "να", "N": "ν"}),
}


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def kind_of(raw: Column) -> Column:
    """The first kind whose form the whole entity has; a value named as a credential that has no other form is one."""
    found = F.lit(None).cast("string")
    for kind, pattern in reversed(_ALONE.items()):
        found = F.when(F.rlike(raw, F.lit(rf"^(?:{pattern})$")), F.lit(kind)).otherwise(found)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("an entity of no kind: "), raw)).cast("string"))


_HEX = "^(?:[0-9a-f]+|[0-9A-F]+)$"
#: What a key starts with before its random part.
_KEY_HEAD = r"^(AKIA|gh[pousr]_|sk-)"


def canonical(kind: Column, raw: Column) -> Column:
    """The same for all spellings of an entity that is no name: lower case where case says nothing, or digits only."""
    as_is = kind.isin("ip", "credential") | ((kind == "secret") & ~F.rlike(raw, F.lit(_HEX)))
    return F.when(as_is, raw).when(kind.isin("email", "secret"), F.lower(raw)).otherwise(_digits(raw))


def _draw(seed: Column, i: Column | int, n: Column | int) -> Column:
    """The i-th number below n that a seed draws."""
    i = i if isinstance(i, Column) else F.lit(i)
    return F.pmod(F.xxhash64(seed, i.cast("int")), n if isinstance(n, Column) else F.lit(n)).cast("int")


def _picker(bank: Column, seed: Column, n: int):
    return lambda i: F.get(bank, _draw(seed, i, n))


def _luhn_total(digits: Column, first_doubled: Column) -> Column:
    """Luhn sum where every other digit counts double, the first one if first_doubled."""
    def one(d: Column, i: Column) -> Column:
        x = d.cast("int") * F.when(((i % 2) == 0) == first_doubled, 2).otherwise(1)
        return F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.transform(F.regexp_extract_all(digits, F.lit(r"\d"), F.lit(0)), one), F.lit(0), lambda a, x: a + x)


def keyed(kind: Column, canon: Column, key: str) -> Column:
    """What surrogates of an entity are drawn from: h if it is hexadecimal, else -, and a keyed hash. Stored, for entities may be long."""
    return F.concat(F.when(F.rlike(canon, F.lit("^[0-9A-Fa-f]+$")), "h").otherwise("-"), F.sha2(F.concat_ws("\u0001", F.lit(key), kind, canon), 256))


def surrogate(kind: Column, canon: Column, drawn_from: Column, attempt: Column) -> Column:
    """The canonical form of the surrogate; a function of what keyed() gives, kind, canonical form and attempt only."""
    seed = F.concat(drawn_from, attempt.cast("string"))
    text = lambda n, letters: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(F.lit(letters), _draw(seed, i, len(letters)) + 1, F.lit(1))), "")
    grown = F.greatest(attempt - 4, F.lit(0))
    local = F.greatest(F.least(F.length(F.substring_index(canon, "@", 1)), F.lit(24)), F.lit(8)) + grown
    email = F.concat(text(local, "abcdefghijklmnopqrstuvwxyz"), F.lit("@mail."), F.lit("example.org"))
    ip = F.concat_ws(".", (_draw(seed, 0, 15) + 240).cast("string"), *[_draw(seed, i, 256).cast("string") for i in (1, 2, 3)])
    long_ip = F.concat_ws(":", F.lit("2001"), F.lit("db8"), *[F.lower(F.hex(_draw(seed, i, 65536).cast("long"))) for i in range(6)])
    # a number keeps its first digit, so that lengths and country stay plausible; the rest is drawn
    size = F.length(canon) + grown
    first = F.substring(canon, 1, 1)
    number = F.concat(first, F.when(attempt < 2, text(F.greatest(size - 1, F.lit(1)), "23456789")).otherwise(text(F.greatest(size - 1, F.lit(1)), "0123456789")))
    start = F.concat(first, text(F.greatest(size - 2, F.lit(1)), "0123456789"))
    valid = _luhn_total(canon, (F.length(canon) % 2) == 0) % 10 == 0
    check = F.pmod(F.lit(10) - _luhn_total(start, ((size - 1) % 2) == 1) % 10, F.lit(10))
    card = F.concat(start, F.when(valid, check).otherwise((check + 1 + _draw(seed, 99, 9)) % 10).cast("string"))
    # digits for digits and letters for letters, within a to f if all is hexadecimal; what has too few of them is drawn anew
    hexadecimal = F.startswith(drawn_from, F.lit("h"))

    def alike(s: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), _draw(seed, i, F.when(hexadecimal, 6).otherwise(26)) + 1, F.lit(1))
            return F.when(c.between("0", "9"), _draw(seed, i, 10).cast("string")).when(c.between("a", "z"), letter).when(c.between("A", "Z"), F.upper(letter)).otherwise(c)

        return F.array_join(F.transform(F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0)), one), "")

    head = F.regexp_extract(canon, _KEY_HEAD, 1)
    hexed = text(F.length(canon), "0123456789abcdef")
    secret = F.when(hexadecimal, hexed).otherwise(F.concat(head, alike(F.substring(canon, F.length(head) + 1, F.length(canon)))))
    few = (F.length(F.regexp_replace(canon, "[^A-Za-z0-9]", "")) < 6) | (attempt > 1)
    credential = F.when(few, F.concat(text(F.lit(11) + grown, "abcdefghijklmnopqrstuvwxyz"), _draw(seed, 99, 10).cast("string"))).otherwise(alike(canon))
    gender, script = (F.get(F.split(canon, "/"), F.lit(i)) for i in range(2))
    made = F.lit(None).cast("string")
    for spelled, (syllables, endings) in SYLLABLES.items():
        bank, last = F.array(*[F.lit(s) for s in syllables]), F.create_map(*[F.lit(x) for pair in endings.items() for x in pair])
        drawn = F.transform(F.sequence(F.lit(1), 3 + 2 * attempt), _picker(bank, seed, len(syllables)))
        made = F.when(script == spelled, F.concat(F.initcap(F.array_join(drawn, "")), F.element_at(last, gender))).otherwise(made)
    named = F.concat_ws("/", gender, script, made)
    ip = F.when(attempt > 4, long_ip).otherwise(ip)
    return F.when(kind == "email", email).when(kind == "secret", secret).when(kind == "ip", ip).when(kind == "card", card).when(kind == "credential", credential).when(kind.isin("given", "surname"), named).otherwise(number)


def written_as(kind: Column, raw: Column, core: Column) -> Column:
    """A surrogate in the form of an occurrence: its separators, its case."""
    filled = F.aggregate(
        F.split(raw, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda acc, ch: F.struct(
            F.concat(acc["out"], F.when(F.rlike(ch, F.lit(r"^\d$")), F.substring(core, acc["at"], F.lit(1))).otherwise(ch)).alias("out"),
            (acc["at"] + F.when(F.rlike(ch, F.lit(r"^\d$")), 1).otherwise(0)).alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(core, acc["at"], F.length(core))),
    )
    word = F.get(F.split(core, "/"), F.lit(2))
    cased = lambda s: F.when((F.upper(raw) == raw) & (F.lower(raw) != raw), F.upper(s)).otherwise(s)
    return F.when(kind.isin("given", "surname"), cased(word)).when((kind == "secret") & ~F.rlike(raw, F.lit(_HEX)), core).when(kind.isin("email", "secret"), cased(core)).when(kind.isin("ip", "credential"), core).otherwise(filled)


def shown(kind: Column, core: Column) -> tuple[Column, Column]:
    """What must not be shared by two entities: the word of a name whatever its place and gender, else kind and canonical form."""
    name = kind.isin("given", "surname")
    return F.when(name, "name").otherwise(kind), F.when(name, F.lower(F.get(F.split(core, "/"), F.lit(2)))).otherwise(core)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """Distinct (kind, canon), and perhaps more columns -> the same with core. Entities in collision draw again; those settled keep what they drew."""
    others = [c for c in entities.columns if c not in ("kind", "canon")]

    def with_shown(df: DataFrame, column: str) -> DataFrame:
        cls, form = shown(F.col("kind"), F.col(column))
        return df.withColumn("cls", cls).withColumn("form", form)

    entities = cut(entities.select("kind", "canon", *others, keyed(F.col("kind"), F.col("canon"), key).alias("drawn_from")))
    drawn = cut(entities.withColumn("core", surrogate(F.col("kind"), F.col("canon"), F.col("drawn_from"), F.lit(0))).withColumn("attempt", F.lit(0)))
    real = with_shown(entities, "canon").select("cls", "form").distinct().withColumn("real", F.lit(True))
    attempt = 0
    while True:
        attempt += 1
        # of those with one surrogate the first stays, unless it is an entity itself
        first = with_shown(drawn, "core").groupBy("cls", "form").agg(F.min(F.struct("attempt", "kind", "canon")).alias("first"), F.count("*").alias("n"))
        bad = cut(first.join(real, ["cls", "form"], "left").where((F.col("n") > 1) | F.col("real")).select("cls", "form", "first", F.coalesce("real", F.lit(False)).alias("real")))
        if bad.isEmpty():
            return drawn.drop("attempt", "drawn_from")
        own = (F.col("first.kind") == F.col("kind")) & (F.col("first.canon") == F.col("canon"))
        judged = with_shown(drawn, "core").join(bad, ["cls", "form"], "left").withColumn("again", F.col("first").isNotNull() & (F.col("real") | ~own))
        again = surrogate(F.col("kind"), F.col("canon"), F.col("drawn_from"), F.lit(attempt))
        drawn = cut(judged.select("kind", "canon", *others, "drawn_from", F.when(F.col("again"), again).otherwise(F.col("core")).alias("core"), F.when(F.col("again"), F.lit(attempt)).otherwise(F.col("attempt")).alias("attempt")))


def _units(rows: DataFrame) -> DataFrame:
    """uid, at, part, kind, canon, lead, raw: a row per entity of each hit; a full name is a given name and a surname. lead stands before it."""
    found = rows.where(F.size("__hits") > 0).select("__uid", F.posexplode("__hits").alias("at", "raw")).withColumn("kind", kind_of(F.col("raw")))
    plain = found.where(F.col("kind") != "name").select("__uid", "at", F.lit(0).alias("part"), "kind", canonical(F.col("kind"), F.col("raw")).alias("canon"), F.lit("").alias("lead"), "raw")
    title = F.regexp_extract("raw", rf"^({_TITLE})\.? ", 1)
    gender = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in TITLES.items() for x in pair]), title), F.lit("N"))
    words = F.split(F.regexp_replace("raw", _TITLED, ""), " ")
    names = found.where(F.col("kind") == "name").select("__uid", "at", gender.alias("told"), F.regexp_extract("raw", rf"({_TITLED})?", 0).alias("title"), words.alias("words"))
    told = F.when(F.col("told") != "N", F.col("told"))
    same = Window.partitionBy("__uid", F.lower(F.element_at("words", -1)))
    one = F.when(F.min(told).over(same) == F.max(told).over(same), F.min(told).over(same))
    names = names.withColumn("gender", F.coalesce(told, one, F.lit("N")))

    def unit(part: int, kind: str, word: Column, lead: Column) -> Column:
        script = F.when(F.rlike(word, F.lit(r"\p{IsCyrillic}")), "cyrillic").when(F.rlike(word, F.lit(r"\p{IsGreek}")), "greek").otherwise("latin")
        return F.struct(F.lit(part).alias("part"), F.lit(kind).alias("kind"), F.concat_ws("/", "gender", script, F.lower(word)).alias("canon"), lead.alias("lead"), word.alias("raw"))

    front, back = F.get("words", F.lit(0)), F.element_at("words", -1)
    full = F.array(unit(0, "given", front, F.col("title")), unit(1, "surname", back, F.lit(" ")))
    parts = F.when(F.size("words") > 1, full).otherwise(F.array(unit(0, "surname", back, F.col("title"))))
    return plain.unionByName(names.select("__uid", "at", F.explode(parts).alias("p")).select("__uid", "at", "p.*"))


def replace_entities(docs: DataFrame, key: str, text_col: str = "text", counted: bool = True) -> DataFrame:
    """docs with each entity of the text replaced by its surrogate, and with n_entities (int) if counted."""
    own = [c for c in docs.columns if not (counted and c == "n_entities")]
    docs, names = shielded(docs, own), [f"k_{c}" for c in own]
    text_col = f"k_{text_col}"
    text = F.col(f"`{text_col}`")
    hits = F.when(F.rlike(text, F.lit(PREFILTER)), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    told = docs.select(F.monotonically_increasing_id().alias("__uid"), *[F.col(f"`{c}`") for c in names], hits.alias("__first"))
    full = F.array_distinct(F.filter(F.transform("__first", lambda h: F.regexp_extract(h, rf"{_TITLED}({_WORD} {_WORD})$", 1)), lambda n: n != ""))
    # names hold letters and a blank only, so they stand in a pattern as they are
    pattern = F.when(F.size("__full") > 0, F.concat(F.lit(rf"{ENTITY}|(?<!\p{{L}})(?=\p{{Lu}})(?:"), F.array_join("__full", "|"), F.lit(r")(?!\p{L})")))
    told = told.withColumn("__full", full).withColumn("__pattern", pattern)
    wider = F.when(F.col("__pattern").isNull(), F.col("__first")).otherwise(F.regexp_extract_all(text, F.col("__pattern"), F.lit(0)))
    rows = stored(told.withColumn("__hits", wider).drop("__first", "__full"), "pii")
    units = cut(_units(rows))
    entities = units.groupBy("kind", "canon").agg(F.count("*").alias("n"))
    total = units.count()
    entity = F.concat_ws("\u0001", "kind", "canon").alias("entity")
    cores = surrogates(entities, key).select(entity, "core", "n")
    met = attach(units.select("__uid", "at", "part", "kind", "lead", "raw", entity), cores, "entity", "n", total)
    swapped = met.select("__uid", F.struct("at", "part", F.concat("lead", written_as(F.col("kind"), F.col("raw"), F.col("core"))).alias("s")).alias("u"))
    lists = swapped.groupBy("__uid").agg(F.collect_list("u").alias("__new"))
    # n hits part a text into n + 1 pieces; piece i stands before hit i
    between = F.when(F.col("__pattern").isNull(), F.split(text, F.lit(ENTITY), -1)).otherwise(F.split(text, F.col("__pattern"), -1))
    pieces = F.transform(between, lambda s, i: F.struct(i.alias("at"), F.lit(-1).alias("part"), s.alias("s")))
    rebuilt = F.array_join(F.transform(F.sort_array(F.concat(pieces, F.col("__new"))), lambda x: x["s"]), "")
    n = [F.size("__hits").alias("n_entities")] if counted else []
    changed = rows.where(F.size("__hits") > 0).join(lists, "__uid")
    changed = changed.select(*[(rebuilt.alias(c) if c == text_col else F.col(f"`{c}`")) for c in names], *n)
    same = rows.where(F.coalesce(F.size("__hits"), F.lit(0)) <= 0).select(*[F.col(f"`{c}`") for c in names], *([F.lit(0).alias("n_entities")] if counted else []))
    return unshielded(same.unionByName(changed), own, *(["n_entities"] if counted else []))
