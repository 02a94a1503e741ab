"""Personal data replaced by surrogates, within DataFrame functions.

One pattern finds e-mail addresses, network addresses, card and account numbers, phone numbers, social security numbers,
secrets and keys, and names after a form of address. Names found so are then looked for in the whole document, also without the
form of address and by given or family name alone. Each entity is normalised (case and separators do not count), and its
surrogate is drawn from a keyed hash of kind and normal form, so all mentions of an entity get the same one: digits for
digits with the separators of the mention, card and account numbers with right check digits, letters for letters in the
mention's case and script, hexadecimal digits for hexadecimal secrets, octets for octets, given names of the same gender and script.
A name's parts are entities of their own, so a surname alone agrees with the full name. The gender of a given name is that
of its form of address; after a neutral one, or without any, that of the same given name elsewhere in the document, or
else what the listed given names or its ending say.

A first job collects the distinct normal forms and checks their surrogates: one that another form has too, or that is
itself an original, is drawn again under a higher attempt number until none is left. The few attempt numbers above zero
go back to the texts that need them, by broadcast where they are few and by a shuffle join beyond that.

What it cannot find: names that stand nowhere in the document after a form of address, and postal addresses. A national phone number
is another entity than the same number with its country code.

Defined results: null texts stay null and have no entities; empty texts stay empty. Texts without an entity are returned
as they are. Rows with null or equal ids are handled like others. An empty table gives an empty one. All columns are
kept but for one named n_entities, which is a result; working columns begin with ``_pii``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, documents, small
from .native import let

#: Forms of address by gender.
MALE = ("Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "M", "Señor", "Sr", "Signor", "Господин", "Г-н")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mademoiselle", "Mme", "Señora", "Señorita", "Sra", "Signora", "Госпожа", "Г-жа")
EITHER = ("Dr", "Prof", "Doctor", "Professor")
GIVEN = {
    "m_latin": ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Noah", "Oscar", "Paul", "Robert", "Simon", "Thomas", "Victor", "Walter"),
    "f_latin": ("Alice", "Bella", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Irene", "Julia", "Laura", "Maria", "Nina", "Olivia", "Paula", "Rosa", "Sara", "Teresa", "Vera", "Zoe"),
    "m_cyrillic": ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Семён", "Тимур"),
    "f_cyrillic": ("Алина", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Ксения", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Светлана", "Юлия"),
}
SYLLABLES = {"latin": ("ba", "de", "fi", "go", "ha", "ke", "li", "mo", "nu", "pe", "ra", "si", "to", "va", "wen", "dor", "lan", "mir", "ras", "tel"), "cyrillic": ("ба", "ве", "го", "да", "жи", "ка", "ле", "ми", "но", "пе", "ра", "си", "то", "ша", "вен", "дор", "лан", "мир", "рас", "тел")}
ENDS = {"m_latin": "n", "f_latin": "a", "m_cyrillic": "н", "f_cyrillic": "а", "latin": "er", "cyrillic": "ов"}

_TITLE = "|".join(sorted(MALE + FEMALE + EITHER, key=len, reverse=True))
#: An apostrophe belongs to a name, but that of a possessive does not.
_NAME = r"\p{Lu}(?:[\p{L}-]|['’](?=\p{L})(?!s(?!\p{L}))){1,40}"
_KEY_LIKE = r"[A-Za-z0-9_/+-]"
#: By kind, in order of precedence. Counts are bounded and runs possessive: no text takes more than linear time.
PATTERNS = {
    "email": r"[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "ip": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![.\d])",
    "ip6": r"(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![\d-])",
    "hex": r"[0-9A-Fa-f]{32,}+(?![\p{L}\p{N}])",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?!\d)",
    # country code and 7 to 14 digits in any groups; 3-3-4; a leading zero and 8 to 13 digits, but for dates
    "phone": r"(?:\+\d(?:[ .()/-]{0,3}\d){7,14}|(?:\(\d{3}\) ?|\d{3}[-.])\d{3}[-. ]\d{4}|(?!\d\d[./-]\d\d[./-]\d)\(?0\d(?:\)? ?[./-]?\d){7,12})(?![\d-])",
    "key": r"(?:AKIA[0-9A-Z]{16}|(?:ghp|gho|ghs|github_pat|sk|pk|xox[abp])[_-][A-Za-z0-9_-]{16,250}|eyJ[A-Za-z0-9_-]{8,2000}(?:\.[A-Za-z0-9_-]{8,4000}){1,2}" + rf"|(?={_KEY_LIKE}{{0,200}}\d)(?={_KEY_LIKE}{{0,200}}[a-z])(?={_KEY_LIKE}{{0,200}}[A-Z]){_KEY_LIKE}{{24,}}+)" + r"(?![\p{L}\p{N}])",
    "name": rf"(?:{_TITLE})\.? {_NAME}(?: {_NAME})?",
}
_BEGIN = r"(?<![\p{L}\p{N}])(?:"
ENTITY = _BEGIN + "|".join(PATTERNS.values()) + ")"
NUMBERS = ("card", "phone", "ssn", "iban")
NAMES = ("surname", "given_m", "given_f")
#: Where the session has this setting, it is the key of the registered queries; the fallback is public and for tests.
KEY_SETTING, PUBLIC_KEY = "spark.rillstone.pii.key", "corpus-key"
#: A form drawn so often without success means that the kind has no free surrogates left.
MAX_ATTEMPTS = 64
#: Rows of (document, attempts) that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 100_000


def _kind(e: Column) -> Column:
    return reduce(lambda c, k: c.when(e.rlike(f"^(?:{PATTERNS[k]})$"), F.lit(k)), [k for k in PATTERNS if k not in ("email", "name")], F.when(e.contains("@"), F.lit("email"))).otherwise(F.lit("name"))


def _draw(seed: Column, i: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(seed, i), F.lit(n)).cast("int")


def _pick(values: tuple[str, ...] | str, at: Column) -> Column:
    if isinstance(values, str):
        return F.substring(F.lit(values), at + 1, F.lit(1))
    return F.get(F.expr("array(" + ", ".join(f"'{v}'" for v in values) + ")"), at)


def _chars(s: Column, body) -> Column:
    return F.array_join(F.transform(F.split(s, ""), body), "")


def _seed(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, norm, attempt.cast("string")), 256)


def _like(c: Column, seed: Column, i: Column) -> Column:
    """A character of the same sort and script."""
    return (
        F.when(c.rlike("[0-9]"), _pick("0123456789", _draw(seed, i, 10)))
        .when(c.rlike(r"\p{IsCyrillic}"), _pick("абвгдежзиклмнопрстуфхчш", _draw(seed, i, 23)))
        .when(c.rlike(r"\p{L}"), _pick("abcdefghijklmnopqrstuvwxyz", _draw(seed, i, 26)))
        .otherwise(c)
    )


def _made_up(seed: Column, attempt: Column, script: str, end: str) -> Column:
    """Three syllables and one more for every attempt, so there is always a free name."""
    return F.concat(F.array_join(F.transform(F.sequence(F.lit(1), 3 + attempt), lambda i: _pick(SYLLABLES[script], _draw(seed, i, len(SYLLABLES[script])))), ""), F.lit(end))


def _luhn(body: Column) -> Column:
    """Digits with the check digit that makes them a card number."""
    doubled = lambda c, i: let(c.cast("int") * (2 - i % 2), lambda x: F.when(x > 9, x - 9).otherwise(x))
    total = F.aggregate(F.transform(F.reverse(F.split(body, "")), doubled), F.lit(0), lambda a, x: a + x)
    return F.concat(body, ((10 - total % 10) % 10).cast("string"))


def _iban(norm: Column) -> Column:
    """An account number with the check digits of its country and the rest."""
    country, rest = F.substring(norm, 1, 2), F.substring(norm, F.lit(5), F.length(norm))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rem = F.aggregate(F.split(F.concat(rest, country, F.lit("00")), ""), F.lit(0), lambda r, c: let(value(c), lambda v: (r * F.when(v > 9, 100).otherwise(10) + v) % 97))
    return F.concat(country, F.lpad((98 - rem).cast("string"), 2, "0"), rest)


def _surrogate(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """The normal form of the surrogate of a normal form."""

    def by_kind(s: Column) -> Column:
        domain = F.regexp_extract(norm, "@(.*)$", 1)
        site = F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1)
        of_site = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("site"), site), 256)
        local = F.regexp_extract(norm, "^([^@]*)@", 1)
        # a short local part would run out of others, so it grows with the attempts
        longer = F.array_join(F.transform(F.sequence(F.lit(0), attempt), lambda i: F.when(i < attempt, _like(F.lit("a"), s, i + 1000)).otherwise("")), "")
        email = F.concat(_chars(local, lambda c, i: _like(c, s, i)), longer, F.lit("@"), _chars(site, lambda c, i: _like(c, of_site, i)), F.regexp_extract(domain, r"(\.[^.]*)$", 1))
        ip = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (_draw(s, i, 254) + 1).cast("string")), ".")
        ip6 = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.lower(F.hex((_draw(s, i, 65535) + 1).cast("long")))), ":")
        hexed = _chars(norm, lambda c, i: _pick("0123456789abcdef", _draw(s, i, 16)))
        marked = F.length(F.regexp_extract(norm, r"^(AKIA|eyJ|(?:ghp|gho|ghs|github_pat|sk|pk|xox[abp])[_-])", 1))
        keyed = _chars(norm, lambda c, i: F.when(i < marked, c).otherwise(let(_like(c, s, i), lambda x: F.when(c.rlike("[A-Z]"), F.upper(x)).otherwise(x))))
        # country codes and what a number's first digits say of its kind stay
        kept = F.when(kind == "phone", F.when(norm.startswith("+"), 3).otherwise(1)).when(kind == "card", 1).when(kind == "iban", 4).otherwise(0)
        number = _chars(norm, lambda c, i: F.when(i < kept, c).otherwise(_like(c, s, i)))
        out = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "ip6", ip6).when(kind == "hex", hexed).when(kind == "key", keyed)
        checked = lambda x: F.when(kind == "card", let(F.substring(x, F.lit(1), F.length(x) - 1), _luhn)).when(kind == "iban", let(F.upper(x), _iban)).otherwise(x)
        for script in SYLLABLES:
            fits = norm.rlike(r"\p{IsCyrillic}") if script == "cyrillic" else ~norm.rlike(r"\p{IsCyrillic}")
            out = out.when((kind == "surname") & fits, _made_up(s, attempt, script, ENDS[script]))
            for gender in "mf":
                listed = tuple(x.lower() for x in GIVEN[f"{gender}_{script}"])
                out = out.when((kind == f"given_{gender}") & fits, F.when(attempt == 0, _pick(listed, _draw(s, F.lit(0), len(listed)))).otherwise(_made_up(s, attempt - 1, script, ENDS[f"{gender}_{script}"])))
        return out.otherwise(let(number, checked))

    return let(_seed(key, kind, norm, attempt), by_kind)


def _title(e: Column) -> Column:
    """The form of address with the blank after it, or nothing."""
    return F.regexp_extract(e, rf"^((?:{_TITLE})\.? )", 1)


def _name(e: Column) -> Column:
    """(gender, given, last) of a mention with a form of address; gender is null after a neutral one, given is empty without one."""
    title, name = F.regexp_extract(_title(e), r"^(.*?)\.? $", 1), F.regexp_replace(e, rf"^(?:{_TITLE})\.? ", "")
    gender = F.when(title.isin(*FEMALE), F.lit("f")).when(title.isin(*MALE), F.lit("m"))
    return F.struct(gender.alias("gender"), F.regexp_extract(name, r"^(\S+) \S+$", 1).alias("given"), F.regexp_extract(name, r"(\S+)$", 1).alias("last"))


def _gender(given: Column, known: Column) -> Column:
    """By the document's own forms of address, the listed names, or the ending."""
    own = F.get(F.filter(known, lambda k: k["gender"].isNotNull() & (F.lower(k["given"]) == F.lower(given))), 0)["gender"]
    listed = {g: [x.lower() for name, of in GIVEN.items() if name[0] == g for x in of] for g in "mf"}
    by_name = F.when(F.lower(given).isin(listed["f"]), "f").when(F.lower(given).isin(listed["m"]), "m").when(F.lower(given).rlike("[aáàäеая]$"), "f").otherwise("m")
    return F.coalesce(own, by_name)


def _units(e: Column, known: Column) -> Column:
    """The parts of a mention that have surrogates: kind, norm, and the surface they stand for. ``known``: the document's titled names."""
    unit = lambda kind, norm, surface: F.struct(kind.alias("kind"), norm.alias("norm"), surface.alias("surface"))
    name = F.regexp_replace(e, rf"^(?:{_TITLE})\.? ", "")
    given, last = F.regexp_extract(name, r"^(\S+) \S+$", 1), F.regexp_extract(name, r"(\S+)$", 1)
    gender = F.coalesce(_name(e)["gender"], _gender(given, known))
    first = lambda g, gender: unit(F.concat(F.lit("given_"), gender), F.lower(g), g)
    surname = unit(F.lit("surname"), F.lower(last), last)
    # a word alone without a form of address is a given name if the document has it as one and not as a surname
    alone = (given == "") & (_title(e) == "") & ~F.exists(known, lambda k: k["last"] == last)
    named = F.when(given != "", F.array(first(given, gender), surname)).when(alone, F.array(first(last, _gender(last, known)))).otherwise(F.array(surname))
    digits = F.regexp_replace(e, r"\D", "")
    norm = lambda k: F.when(k.isin("card", "ssn"), digits).when(k == "phone", F.when(e.startswith("+"), F.concat(F.lit("+"), digits)).otherwise(digits)).when(k == "iban", F.regexp_replace(e, " ", "")).when(k == "key", e).otherwise(F.lower(e))
    return let(_kind(e), lambda k: F.when(k == "name", named).otherwise(F.array(unit(k, norm(k), e))))


def _dress(surface: Column, kind: Column, surrogate: Column) -> Column:
    """The surrogate in the case and with the separators of the mention."""
    plain = F.regexp_replace(surrogate, r"[+]", "")
    before = lambda i: F.length(F.regexp_replace(F.substring(surface, F.lit(1), i), r"[^\p{L}\p{N}]", ""))
    numbers = _chars(surface, lambda c, i: F.when(c.rlike(r"[\p{L}\p{N}]"), F.substring(plain, before(i) + 1, F.lit(1))).otherwise(c))
    shouted = (surface == F.upper(surface)) & (surface != F.lower(surface))
    worded = F.when(shouted & (F.length(surface) > 1), F.upper(surrogate)).when(kind.isin(*NAMES), F.initcap(surrogate)).otherwise(surrogate)
    return F.when(kind.isin(*NUMBERS), numbers).when(kind == "key", surrogate).otherwise(worded)


def _attempts(units: DataFrame, key: str) -> DataFrame | None:
    """kind, norm, attempt for the forms whose first surrogate is taken; None where there are none. Has a row of ``units`` for each form."""
    drawn = units.select("kind", "norm", F.lit(0).alias("attempt"))
    own = units.select("kind", F.col("norm").alias("surrogate"))
    for attempt in range(MAX_ATTEMPTS):
        with_one = checkpointed(drawn.withColumn("surrogate", _surrogate(key, F.col("kind"), F.col("norm"), F.col("attempt"))))
        first = Window.partitionBy("kind", "surrogate").orderBy("attempt", "norm")  # who has it keeps it
        taken = with_one.withColumn("_pii_n", F.row_number().over(first)).where("_pii_n > 1").select("kind", "norm")
        clash = checkpointed(taken.unionByName(with_one.join(own, ["kind", "surrogate"], "left_semi").select("kind", "norm")).distinct())
        if clash.isEmpty():
            return None if attempt == 0 else with_one.where("attempt > 0").select("kind", "norm", "attempt")
        again = with_one.join(clash.withColumn("_pii_c", F.lit(1)), ["kind", "norm"], "left")
        drawn = again.select("kind", "norm", F.when(F.col("_pii_c").isNotNull(), F.lit(attempt + 1)).otherwise(F.col("attempt")).alias("attempt"))
    raise ValueError(f"no free surrogates after {MAX_ATTEMPTS} attempts")


def with_entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with _pii_found (the mentions), _pii_pattern (what finds them in this text) and _pii_known (the names with a form of address)."""
    t = F.coalesce(F.col(text), F.lit(""))
    marked = docs.withColumn("_pii_found", F.regexp_extract_all(t, F.lit(ENTITY), F.lit(0)))
    known = F.array_distinct(F.transform(F.filter("_pii_found", lambda e: (_title(e) != "") & (_kind(e) == "name")), _name))
    marked = marked.withColumn("_pii_known", known)
    parts = F.array_distinct(F.flatten(F.transform("_pii_known", lambda k: F.array(F.concat(k["given"], F.lit(" "), k["last"]), k["last"], k["given"]))))
    quoted = F.transform(F.filter(parts, lambda x: (x != "") & ~x.startswith(" ")), lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E(?![\p{L}\p{N}])")))
    own = F.concat(F.lit(ENTITY[:-1] + "|"), F.array_join(quoted, "|"), F.lit(")"))
    marked = marked.withColumn("_pii_pattern", F.when(F.size("_pii_known") > 0, own))
    again = F.regexp_extract_all(t, F.col("_pii_pattern"), F.lit(0))
    return marked.withColumn("_pii_found", F.when(F.col("_pii_pattern").isNotNull(), again).otherwise(F.col("_pii_found")))


def replace(docs: DataFrame, key: str = PUBLIC_KEY, text: str = "text") -> DataFrame:
    """``docs`` with entities in ``text`` replaced, and n_entities, their number. Keep ``key`` secret: who has it can test guesses."""
    marked = with_entities(docs.drop("n_entities"), text).withColumn("_pii_text", F.xxhash64(text))
    per_unit = marked.select("_pii_text", F.explode(F.flatten(F.transform("_pii_found", lambda e: _units(e, F.col("_pii_known"))))).alias("u")).select("_pii_text", "u.kind", "u.norm")
    per_unit = checkpointed(per_unit.distinct())  # of equal texts once
    retried = _attempts(per_unit.select("kind", "norm").distinct(), key)
    if retried is None:
        marked = marked.withColumn("_pii_tries", F.lit(None).cast("map<string,int>"))
    else:
        tries = per_unit.join(retried, ["kind", "norm"]).groupBy("_pii_text")  # as many as the text has at most
        tries = checkpointed(tries.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x1f", "kind", "norm"), "attempt"))).alias("_pii_tries")))
        marked = marked.join(F.broadcast(tries) if small(tries, BROADCAST_ROWS) else tries, "_pii_text", "left")

    def new(e: Column) -> Column:
        def one(u: Column) -> Column:
            tried = F.coalesce(F.try_element_at(F.col("_pii_tries"), F.concat_ws("\x1f", u["kind"], u["norm"])), F.lit(0))
            return _dress(u["surface"], u["kind"], _surrogate(key, u["kind"], u["norm"], tried))

        def whole(us: Column) -> Column:
            named = F.get(us, 0)["kind"].isin(*NAMES)
            return let(F.transform(us, one), lambda xs: F.when(named, F.concat(_title(e), F.array_join(xs, " "))).otherwise(F.get(xs, 0)))

        return let(_units(e, F.col("_pii_known")), whole)

    between = F.when(F.col("_pii_pattern").isNotNull(), F.split(F.col(text), F.col("_pii_pattern"), -1)).otherwise(F.split(F.col(text), ENTITY, -1))
    joined = F.array_join(F.zip_with(between, F.concat(F.transform("_pii_found", new), F.array(F.lit(""))), lambda p, e: F.concat(p, e)), "")
    changed = marked.withColumn("_pii_new", F.when(F.size("_pii_found") > 0, joined).otherwise(F.col(text)))
    out = [F.col("_pii_new").alias(c) if c == text else F.col(c) for c in docs.columns if c != "n_entities"]
    return changed.select(*out, F.size("_pii_found").alias("n_entities"))


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace(documents(spark, sf_dir).select("doc_id", "text"), spark.conf.get(KEY_SETTING, PUBLIC_KEY))
