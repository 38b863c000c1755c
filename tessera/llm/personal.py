"""Personal data replaced by keyed surrogates of the same type, gender, script and format."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stage

# What is detected, in order of preference where two start alike. Repeats are bounded or give nothing
# back, and most start outside words, so a long run of letters or labels is left after a few steps at each place.
START = r"(?<![\p{L}\p{N}])"
EMAIL = r"[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}+@(?:[A-Za-z0-9-]{1,63}+\.){1,30}[A-Za-z]{2,63}"
IBAN = r"(?<!_)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}_])"
IPV4 = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])"
CARD = r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z])|(?<![0-9A-Za-z+])\+[0-9]{8,15}(?![0-9])"
MALE = r"Mr\.?|Mister|Sir|Herrn?|Monsieur|Señor|Sr\.|Господин|Κύριος"
FEMALE = r"Mrs\.?|Ms\.?|Miss|Madam|Frau|Madame|Mme\.?|Mademoiselle|Señora|Señorita|Sra\.|Госпожа|Κυρία"
TITLE = rf"(?<![\p{{L}}])(?=[MHSFГΚ])(?:{FEMALE}|{MALE})"
NAMED = r"\p{Lu}[\p{L}'’-]+"
NAME = rf"{TITLE}\x20{NAMED}(?:\x20{NAMED})?"
KINDS = {"email": EMAIL, "iban": IBAN, "ip": IPV4, "ssn": SSN, "card": CARD, "phone": PHONE, "name": NAME}
ANY = rf"{START}(?:{EMAIL}|{IBAN})|(?=[0-9])(?:{IPV4}|{SSN})|{START}(?:(?=[0-9+(])(?:{CARD}|{PHONE})|{NAME})"
#: In texts with a titled name every capitalised word is looked at; those that are no part of one stay.
ANY_WORD = rf"{ANY}|{START}{NAMED}"
#: What a text must have to hold any of these.
HINT = rf"[0-9@]|{NAME}"
# Syllables of invented names, and how given names end, by script and gender.
SYLLABLES = {
    "latin": ("ba", "del", "fin", "gar", "hol", "kem", "lor", "mi", "nar", "pel", "ras", "sol", "tam", "ver", "win", "zel"),
    "cyrillic": ("ба", "дел", "фин", "гар", "хол", "кем", "лор", "ми", "нар", "пел", "рас", "сол", "там", "вер", "вин", "зел"),
    "greek": ("βα", "δελ", "φιν", "γαρ", "χολ", "κεμ", "λορ", "μι", "ναρ", "πελ", "ρας", "σολ", "ταμ", "βερ", "βιν", "ζελ"),
}
ENDINGS = {"latin": ("a", "o"), "cyrillic": ("а", "ий"), "greek": ("α", "ος")}
#: Rounds in which colliding units try the next surrogate before the job gives up.
ROUNDS = 64
#: Rounds after which names and local parts of addresses get longer, and octets any length.
WIDEN = 4


def kind_of(found: Column) -> Column:
    out = None
    for kind, pattern in KINDS.items():
        test = found.rlike(f"^(?:{pattern})$")
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("word")


def hex_stream(value: Column, kind: Column, attempt: Column, key: str) -> Column:
    """256 hex digits that depend on the key, kind, value and attempt."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, value, attempt.cast("string"))
    return F.concat(*[F.sha2(F.concat(seed, F.lit(f"\x1f{i}")), 256) for i in range(4)])


def _number(stream: Column, at: Column | int, size: int = 4) -> Column:
    place = at * size + 1 if isinstance(at, Column) else F.lit(at * size + 1)
    # a value longer than the stream wraps around; its place is added so that digits still differ
    wrapped = F.pmod(place - 1, F.lit(256 - size)) + 1
    return F.conv(F.substr(stream, wrapped, F.lit(size)), 16, 10).cast("int") + place


def substitute(value: Column, stream: Column) -> Column:
    """Letters for letters and digits for digits of the same kind, case and script; the rest stays."""

    def one(c: Column, i: Column) -> Column:
        n = _number(stream, i)

        def pick(pool: str) -> Column:
            return F.substr(F.lit(pool), F.pmod(n, F.lit(len(pool))) + 1, F.lit(1))

        first = F.when(i == 0, pick("123456789")).otherwise(pick("0123456789"))
        return (
            F.when(c.rlike("^[0-9]$"), first)
            .when(c.rlike("^[a-z]$"), pick("abcdefghijklmnopqrstuvwxyz"))
            .when(c.rlike("^[A-Z]$"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            .when(c.rlike(r"^[\p{IsCyrillic}&&\p{Ll}]$"), pick("абвгдежзиклмнопрстуфхцчшэюя"))
            .when(c.rlike(r"^[\p{IsGreek}&&\p{Ll}]$"), pick("αβγδεζηθικλμνξοπρστυφχψω"))
            .when(c.rlike(r"^\p{L}$"), pick("abcdefghijklmnopqrstuvwxyz"))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), one), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string, the last digit counting once."""
    reverse = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")

    def weigh(c: Column, i: Column) -> Column:
        d = c.cast("int") * (F.pmod(i, F.lit(2)) + 1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(reverse, weigh), F.lit(0), lambda a, x: a + x)


def surrogate(kind: Column, value: Column, attempt: int, key: str) -> Column:
    """The surrogate of a unit; see ``units_of`` for what ``value`` is of each kind.

    Every WIDEN attempts names get one more syllable and local parts of addresses one more
    letter, and from the first time on octets may have any length, so that a corpus with
    more names or short addresses than there are surrogates of their length has enough.
    Numbers keep their digits.
    """
    stream = hex_stream(value, kind, F.lit(attempt), key)
    more = attempt // WIDEN
    plain = substitute(value, stream)
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    labels = F.split(domain, r"\.")
    host = F.when(F.size(labels) > 2, F.concat(substitute(F.array_join(F.slice(labels, 1, F.size(labels) - 2), "."), F.reverse(stream)), F.lit("."))).otherwise("")
    top = F.element_at(labels, -1)
    email = F.concat(substitute(F.concat(local, F.lit("x" * more)), stream), F.lit("@"), host, F.lit("example."), F.when(top.isin("com", "org", "net"), top).otherwise("com"))

    def octet(o: Column, i: Column) -> Column:
        n = _number(stream, i)
        if more:
            return (F.pmod(n, F.lit(254)) + 1).cast("string")
        return F.when(F.length(o) == 1, F.pmod(n, F.lit(9)) + 1).when(F.length(o) == 2, F.pmod(n, F.lit(90)) + 10).otherwise(F.pmod(n, F.lit(156)) + 100).cast("string")

    ip = F.array_join(F.transform(F.split(value, r"\."), octet), ".")
    body = F.left(plain, F.length(plain) - 1)
    check = F.pmod(-_luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    card = F.when(F.pmod(_luhn_sum(value), F.lit(10)) == 0, F.concat(body, check)).otherwise(plain)
    iban = F.concat(F.left(value, F.lit(2)), substitute(F.substr(value, F.lit(3)), stream))

    def invented(script: str, ending: Column) -> Column:
        pool = F.array(*map(F.lit, SYLLABLES[script]))
        return F.initcap(F.concat(*[F.element_at(pool, F.pmod(_number(stream, i), F.lit(16)) + 1) for i in range(4 + more)], ending))

    def name(place: int | None) -> Column:
        by_script = {s: invented(s, F.lit(ENDINGS[s][place] if place is not None else "")) for s in SYLLABLES}
        return F.when(value.rlike(r"\p{IsCyrillic}"), by_script["cyrillic"]).when(value.rlike(r"\p{IsGreek}"), by_script["greek"]).otherwise(by_script["latin"])

    country = F.greatest(F.length(value) - 10, F.lit(0))
    phone = F.concat(F.left(value, country), substitute(F.substr(value, country + 1), stream))
    return (
        F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "ip", ip).when(kind == "card", card).when(kind == "iban", iban)
        .when(kind == "given female", name(0)).when(kind == "given male", name(1)).when(kind == "surname", name(None))
        .otherwise(plain)
    )


def units_of(kind: Column, found: Column) -> Column:
    """array<struct<kind,value>> of what is replaced in a detected text, in order.

    Spellings of one thing share a unit, so they share a surrogate: an e-mail address in lower case,
    the digits of numbers, the parts of a name each on its own (a surname alone goes with
    the full name; a given name also carries the gender of its title).
    """
    digits = F.regexp_replace(found, "[^0-9]", "")
    parts = F.split(F.regexp_replace(found, rf"^{TITLE}\x20", ""), " ")
    gender = F.when(found.rlike(rf"^(?:{FEMALE})\x20"), "given female").otherwise("given male")

    def unit(k: Column, v: Column) -> Column:
        return F.struct(k.alias("kind"), v.alias("value"))

    surname = unit(F.lit("surname"), F.element_at(parts, -1))
    names = F.when(F.size(parts) > 1, F.array(unit(gender, F.element_at(parts, 1)), surname)).otherwise(F.array(surname))
    none = F.array().cast("array<struct<kind:string,value:string>>")
    single = F.when(kind == "email", F.lower(found)).when(kind == "ip", found).when(kind == "iban", F.regexp_replace(found, " ", "")).otherwise(digits)
    return F.when(kind == "word", none).when(kind == "name", names).otherwise(F.array(unit(kind, single)))


def rendered(kind: Column, found: Column, given: Column) -> Column:
    """The surrogates ``given`` of a detected text's units, put in its format."""
    only = F.element_at(given, 1)
    chars = F.filter(F.split(found, ""), lambda c: c != "")

    def refilled(taken: str) -> Column:
        """``found`` with the characters of ``only`` in place of those that match ``taken``."""

        def step(s: Column, c: Column) -> Column:
            put = c.rlike(taken)
            k, out = s["k"] + put.cast("int"), F.when(put, F.substr(only, s["k"] + 1, F.lit(1))).otherwise(c)
            return F.struct(k.alias("k"), F.concat(s["out"], out).alias("out"))

        return F.aggregate(chars, F.struct(F.lit(0).alias("k"), F.lit("").alias("out")), step)["out"]

    title = F.regexp_extract(found, rf"^({TITLE}\x20)", 1)
    email = F.when(found == F.upper(found), F.upper(only)).otherwise(only)
    return F.when(kind == "word", found).when(kind == "name", F.concat(title, F.array_join(given, " "))).when(kind == "email", email).when(kind == "ip", only).when(kind == "iban", refilled("[^ ]")).otherwise(refilled("[0-9]"))


def assign_surrogates(units: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) of distinct (kind, value): no two units of a kind share one.

    Nor is a surrogate the value of another unit of the corpus. Units that collide try the next
    surrogate, the smallest of them keeping the first, until none does.
    """
    real = units.select("kind", F.col("value").alias("surrogate"))
    left, done = units, None
    for attempt in range(ROUNDS):
        tried = left.withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), attempt, key))
        free = tried.join(real, ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = stage(free.groupBy("kind", "surrogate").agg(F.min("value").alias("value")).select("kind", "value", "surrogate"))
        done = won if done is None else done.unionByName(won)
        left = stage(left.join(won, ["kind", "value"], "left_anti"))
        if left.isEmpty():
            return done
    raise RuntimeError(f"no free surrogate after {ROUNDS} rounds")


def replace_personal(docs: DataFrame, key: str = "surrogates", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``entities`` array<struct<kind, found, surrogate>>, ``text``.

    Surrogates depend on ``key`` and the unit alone, so a unit has the same one in all documents
    and runs, and different units have different ones (``assign_surrogates``). Format, digit
    count, Luhn validity, country codes, gender of a title and script are kept.

    A name is found by a title; its words are then replaced wherever they stand capitalised in the same
    text, with the title or without. Names that never have a title are not found.

    Null text stays null and has no entities; other texts without personal data stay as they are. Rows that repeat an
    id with the same text get the same result. An empty table gives an empty result. Columns
    not named are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    digest, named = F.xxhash64("text"), F.col("text").rlike(NAME)

    def by_names(f: Callable[[str], Column]) -> Column:
        return F.when(named, f(ANY_WORD)).otherwise(f(ANY))

    hits = F.posexplode(by_names(lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0)))).alias("at", "found")
    some = rows.filter(F.col("text").rlike(HINT)).select("doc_id", digest.alias("_d"), hits)
    found = stage(some.distinct().withColumn("kind", kind_of(F.col("found"))).withColumn("units", units_of(F.col("kind"), F.col("found"))))
    titled = found.filter("kind = 'name'").select("doc_id", "_d", F.explode("units").alias("u")).groupBy("doc_id", "_d", F.col("u.value").alias("word")).agg(F.min("u").alias("u"))
    same = F.col("f.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("f._d") == F.col("t._d")) & (F.col("found") == F.col("word"))
    words = found.filter("kind = 'word'").alias("f").join(titled.alias("t"), same, "left")
    words = words.select("f.doc_id", "f._d", "at", "found", F.when(F.col("u").isNull(), "word").otherwise("name").alias("kind"), F.when(F.col("u").isNull(), F.col("units")).otherwise(F.array("u")).alias("units"))
    detected = stage(found.filter("kind <> 'word'").unionByName(words))
    units = stage(detected.select(F.explode("units").alias("u")).select("u.kind", "u.value").distinct())
    table = assign_surrogates(units, key)
    each = detected.select("doc_id", "_d", "at", "found", "kind", F.posexplode_outer("units").alias("part", "u"))
    joined = each.join(table.withColumnRenamed("kind", "_k"), (F.col("u.kind") == F.col("_k")) & (F.col("u.value") == F.col("value")), "left")
    whole = joined.groupBy("doc_id", "_d", "at", "found", "kind").agg(F.transform(F.sort_array(F.collect_list(F.struct("part", "surrogate"))), lambda x: x["surrogate"]).alias("given"))
    put = whole.withColumn("surrogate", rendered(F.col("kind"), F.col("found"), F.col("given")))
    per_doc = put.groupBy("doc_id", "_d").agg(F.sort_array(F.collect_list(F.struct("at", "kind", "found", "surrogate"))).alias("put"))
    both = rows.withColumn("_d", digest).alias("d").join(per_doc.alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d._d") == F.col("p._d")), "left")
    gaps = by_names(lambda p: F.split("text", p, -1))
    ends = F.concat(F.transform("put", lambda x: x["surrogate"]), F.array(F.lit("")))
    new = F.array_join(F.transform(F.arrays_zip(gaps.alias("gap"), ends.alias("end")), lambda x: F.concat(x["gap"], x["end"])), "")
    entities = F.transform(F.filter("put", lambda x: x["kind"] != "word"), lambda x: F.struct(x["kind"].alias("kind"), x["found"].alias("found"), x["surrogate"].alias("surrogate")))
    return both.select(
        F.col("d.doc_id").alias("doc_id"),
        F.coalesce(entities, F.array().cast("array<struct<kind:string,found:string,surrogate:string>>")).alias("entities"),
        F.when(F.col("put").isNull(), F.col("text")).otherwise(new).alias("text"),
    )


def personal_digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.size("entities").cast("long").alias("n_entities"), F.array_join(F.transform("entities", lambda x: x["kind"]), ",").alias("kinds"), "text")
