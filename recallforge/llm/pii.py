"""Surrogates for personal data, with DataFrame functions only.

Detected entities (e-mail addresses, phone, card and account numbers, IPv4 addresses, credentials, personal names) are
replaced by others of the same type. A surrogate is a function of the key, the type and the entity alone, so an entity
that occurs again, in any document, gets the same surrogate: coreference holds without any join.

* Characters are replaced class by class: a digit by a digit, a letter by a letter of its script and case; separators,
  country codes, top-level domains and key prefixes stay, so spellings of one number or address stay spellings of one.
* Octets stay octets; a card number that satisfies the Luhn rule gets one that does, and an account number with right
  check digits gets right ones.
* A given name is replaced by the next one, in keyed order, of the same gender and script: one to one, never by itself.
  A surname is replaced part by part, hyphens and apostrophes kept, by syllables of its script; Slavic endings stay, and
  a family's feminine and masculine names get surrogates of one stem.
* A name that was found is replaced wherever it is a whole word of the same text, in capitals too.

Collision check: all distinct entities get their surrogates; where one is also an entity of the corpus, or belongs to
two entities, all but one of those concerned are tried again with a higher number until every surrogate is new and
distinct. The few tries that differ from 0 are exceptions, sent along as a literal up to ``literal_exceptions`` of
them; more are joined to the documents that hold them.

Defined cases: a null text stays null, a text without entities stays as it is; repeated rows are treated alike; an
empty table gives no rows; further columns are kept as they are, whatever their names, but n_chars follows the new text;
where there is a column n_entities already, it stays and no count is added.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import stored

# Common given names by script and gender, and titles by gender.
GIVEN = {
    "latin_f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Anna Emma Julia Laura Sophie Marie Claire Camille Isabelle Monika Petra Ursula Sabine Carmen Lucía Elena Paula".split(),
    "latin_m": "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Peter Paul Pierre Jean François Hans Klaus Jürgen Stefan José Luis Carlos Javier Miguel Pablo Antonio".split(),
    "cyrillic_f": "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина".split(),
    "cyrillic_m": "Иван Александр Сергей Дмитрий Андрей Алексей Михаил Владимир Николай".split(),
}
TITLES = {
    "f": "Mrs Ms Miss Madame Mme Mademoiselle Mlle Frau Señora Señorita Sra Srta Signora Госпожа".split(),
    "m": "Mr Mister Sir Monsieur Herr Señor Sr Signor Господин".split(),
    "": "Dr Prof Professor".split(),
}
SYLLABLES = {
    "latin": "ba be bo da den der dor el fen gar hal har hol ik jor ka kel ker lan lar len lin lor mar mer mon nar nel nor pel per ral ran ren rin ros sal sen ser sol tan tel ter tor val van vel ver win".split(),
    "cyrillic": "ба бе бо да де до ка ке ко ла ле ло ма ме мо на не но ра ре ро са се со та те то ва ве во".split(),
    "greek": "βα βε βο δα δε δο κα κε κο λα λε λο μα με μο να νε νο ρα ρε ρο σα σε σο τα τε το".split(),
    "armenian": "բա կա մա նա րա սա տա վա լե մե նե րե սե տե բո կո մո նո րո տո".split(),
}
#: What Slavic surnames end in, by gender; the longest first.
FEMININE, MASCULINE = "ская цкая ова ева ёва ина ына ая".split(), "ский цкий ов ев ёв ин ын ий ой".split()
#: Country calling codes of one and two digits, as a pattern; the others have three.
CALLING_CODES = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
LETTERS = {
    "latin": ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "latin with marks": ("àáâãäåçèéêëìíîïñòóôõöùúûüý", "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"),
    "greek": ("αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    "cyrillic": ("абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"),
    "hebrew": ("אבגדהוזחטיכלמנסעפצקרשת", ""),
    "arabic": ("ابتثجحخدذرزسشصضطظعغفقكلمنهوي", ""),
}
KEY_PREFIXES = "AKIA ASIA ghp_ gho_ ghs_ sk- pk- xoxb- xoxp- AIza".split()
SECRET_NAMES = "password passwd pwd secret token api_key apikey access_key auth_token client_secret".split()

_given = "|".join(n for names in GIVEN.values() for n in names)
#: In lower case too, but for words that mean something else there.
_titles = "(?iu:" + "|".join(t for titles in TITLES.values() for t in titles if t not in ("Miss", "Ms")) + ")|Miss|MISS|Ms|MS"
#: Words that are no surname after a given name where all is in upper case.
_small = "AND OR BUT THE AN IN ON AT OF TO FOR FROM BY WITH IS ARE WAS WERE HAS HAVE HAD WILL WOULD CAN DOES DID NOT WHO THAT THIS AS IF ET OU LE LA LES DE DU DES UN UNE EST QUI QUE DANS POUR PAR AVEC SUR UND ODER DER DIE DAS DEN IST WAR HAT MIT VON ZU AUF FÜR EL LOS LAS ES CON POR EN НА НЕ ЧТО".replace(" ", "|")
_name = r"\p{Lu}[\p{L}'-]+(?<!['-])(?<!'[sS])"
#: Patterns by type, in order of precedence. Every entity begins at the start of a word, and what is cheap to test for
#: is tested first: over prose the matcher stops at nearly every word after one or two characters per pattern.
PATTERNS = {
    "email": r"(?<![._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@[\p{L}\p{N}](?:[\p{L}\p{N}-]*\.)+\p{L}{2,24}",
    "secret": r"(?<=[=:\"'\s])(?<=[=:][\"'\s]{0,5})(?<=\b(?i:" + "|".join(SECRET_NAMES) + r")[\"']?\s{0,2}[=:]\s{0,2}[\"']?)[A-Za-z0-9_./+-]{8,}+|(?:" + "|".join(KEY_PREFIXES) + r")[A-Za-z0-9_-]{12,}+",
    "ip": r"(?=\d)(?<!\.)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\p{N}]|\.\d)",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ssn": r"(?=\d)(?<!-)\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "card": r"(?=\d)(?<!\+)(?:(?:\d{4} ){3}\d{4}(?: \d{1,3})?|(?:\d{4}-){3}\d{4}(?:-\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{4,5}|\d{13,19})(?![\p{L}\p{N}])",
    "phone": r"(?=[+(\d])(?<!\+)(?:(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{2,4}[ .-]?\d{3,4}(?!\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\p{L}\p{N}-]))",
    "name": r"(?=\p{Lu})(?:(?<= )(?<=\b(?:" + _titles + r")\.? )" + _name + r"|(?<= )(?<=\b(?:" + _titles + r")\.? (?iu:" + _given + r") )" + _name + r"|(?iu:" + _given + r")(?= (?!(?:" + _small + r")(?!\p{L}))\p{Lu}\p{L})|(?<= )(?<=(?:^|[^\p{L}])(?iu:" + _given + r") )(?!(?:" + _small + r")(?!\p{L}))" + _name + r")",
}
PATTERN = r"(?<![\p{L}\p{N}])(?=[\p{L}\p{N}+(/_.-])(?:" + "|".join(PATTERNS.values()) + ")"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def entity_type(m: Column) -> Column:
    """The type of a match: that of the first pattern that could have made it."""
    digits = F.length(F.regexp_replace(m, r"\D", ""))
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"), "ip")
        .when(m.rlike(r"^[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3}") & m.rlike(r"^[A-Z0-9 ]+$") & ~m.rlike("^(?:AKIA|ASIA)"), "iban")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(m.rlike(r"^\d(?:[ -]?\d){12,18}$"), "card")
        .when(m.rlike(r"^[+(]") | m.rlike(r"^\d{3}[.-]\d{3}[.-]\d{4}$") & (digits == 10), "phone")
        .when(m.rlike(rf"^(?iu:{_given})$"), "given")
        .when(m.rlike(r"^\p{Lu}[\p{L}'-]*$") & ~m.rlike("^(?:" + "|".join(KEY_PREFIXES) + ")"), "surname")
        .otherwise("secret")
    )


def identity(kind: Column, m: Column) -> Column:
    """What spellings of one entity, and the names of one family, have in common."""
    lower = F.lower(m)
    family = F.when(m.rlike(r"\p{IsCyrillic}"), F.regexp_replace(F.regexp_replace(lower, "([оеё]в|[иы]н)а$", "$1"), "([сц]к)ая$", "$1ий")).otherwise(lower)
    digits = F.regexp_replace(m, r"\D", "")
    return F.when(kind.isin("phone", "card", "ssn"), digits).when(kind == "iban", F.regexp_replace(m, " ", "")).when(kind == "surname", family).when(kind.isin("email", "given"), lower).otherwise(m)


def _pick(seed: Column, n: Column | int) -> Column:
    return F.pmod(seed, F.lit(n) if isinstance(n, int) else n).cast("int")


def _char(c: Column, seed: Column, hexadecimal: Column) -> Column:
    """A character of the class of ``c``; characters of no class known here stay."""
    out = F.when(c.between("0", "9"), F.substring(F.lit("0123456789"), _pick(seed, 10) + 1, F.lit(1)))
    out = out.when(hexadecimal & c.between("a", "f"), F.substring(F.lit("abcdef"), _pick(seed, 6) + 1, F.lit(1)))
    for lower, upper in LETTERS.values():
        for case in filter(None, (lower, upper)):
            out = out.when(F.lit(case).contains(c), F.substring(F.lit(case), _pick(seed, len(case)) + 1, F.lit(1)))
    return out.otherwise(c)


def _substitute(kind: Column, m: Column, seed: Column) -> Column:
    """Character by character; the nth letter or digit depends on n, not on separators before it."""
    keep = F.when(kind == "phone", F.when(m.rlike(r"^\+"), F.length(F.regexp_extract(F.regexp_replace(m, r"\D", ""), rf"^({CALLING_CODES}|\d{{3}})", 1))).otherwise(0))
    keep = keep.when(kind == "secret", F.length(F.regexp_extract(m, "^(" + "|".join(KEY_PREFIXES) + ")", 1))).when(kind == "iban", 2).otherwise(0)
    tail = F.when(kind == "email", F.length(F.regexp_extract(m, r"\.(\p{L}+)$", 1))).otherwise(0)
    fixed = F.struct(keep.alias("keep"), (F.length(m) - tail).alias("end"), m.rlike("^[0-9a-f]+$").alias("hex"), seed.alias("seed"))

    def spell(b: Column) -> Column:
        start = F.struct(F.lit("").alias("s"), F.lit(0).alias("k"), F.lit(0).alias("i"))

        def step(a: Column, c: Column) -> Column:
            counted = c.rlike(r"[\p{L}\p{N}]")
            new = F.when(counted & (a["k"] >= b["keep"]) & (a["i"] < b["end"]), _char(c, F.xxhash64(b["seed"], a["k"]), b["hex"])).otherwise(c)
            return F.struct(F.concat(a["s"], new).alias("s"), (a["k"] + counted.cast("int")).alias("k"), (a["i"] + 1).alias("i"))

        # Secrets can be long and have one spelling: no running count, so that time grows with length only.
        plain = F.transform(F.split(m, ""), lambda c, i: F.when((i >= b["keep"]) & (i < b["end"]), _char(c, F.xxhash64(b["seed"], i), b["hex"])).otherwise(c))
        return F.when(kind == "secret", F.array_join(plain, "")).otherwise(F.aggregate(F.split(m, ""), start, step, lambda a: a["s"]))

    return let(fixed, spell)


def luhn_sum(digits: Column) -> Column:
    """Sum of the Luhn rule over a string of digits, the last one undoubled."""

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, d: a + d)


def _card(m: Column, spelled: Column) -> Column:
    """``spelled``, its last digit such that the Luhn sum's last digit is that of ``m`` if that is 0."""
    plain = lambda x: F.regexp_replace(x, r"\D", "")

    def fix(s: Column) -> Column:
        body = s.substr(F.lit(1), F.length(s) - 1)
        last = F.pmod(F.lit(10) - luhn_sum(F.concat(plain(body), F.lit("0"))), F.lit(10))
        return F.when(luhn_sum(plain(m)) % 10 == 0, F.concat(body, last.cast("string"))).otherwise(s)

    return let(spelled, fix)


def mod_97(letters_and_digits: Column) -> Column:
    """The remainder that the check digits of account numbers rest on; letters count from A = 10."""

    def step(r: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (r * 10 + c.cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(letters_and_digits, ""), F.lit(0), step)


def _iban(m: Column, spelled: Column) -> Column:
    """``spelled``, with right check digits if those of ``m`` are right."""
    turned = lambda x, check: F.concat(F.regexp_replace(x.substr(F.lit(5), F.length(x)), " ", ""), F.substring(x, 1, 2), check)

    def fix(s: Column) -> Column:
        check = F.lpad((F.lit(98) - mod_97(turned(s, F.lit("00")))).cast("string"), 2, "0")
        right = mod_97(turned(m, F.substring(m, 3, 2))) == 1
        return F.when(right, F.concat(F.substring(s, 1, 2), check, s.substr(F.lit(5), F.length(s)))).otherwise(s)

    return let(spelled, fix)


def _given_name(key: str, m: Column) -> Column:
    """The next name of the same list in keyed order, in the case of ``m``."""
    plain = F.initcap(F.lower(m))

    def of(names: list[str]) -> Column:
        keyed = F.transform(F.array(*map(F.lit, names)), lambda n: F.struct(F.xxhash64(F.lit(key), n).alias("h"), n.alias("n")))
        order = F.transform(F.array_sort(keyed), lambda s: s["n"])
        return let(order, lambda o: F.element_at(o, (F.array_position(o, plain) % len(names) + 1).cast("int")))

    name = reduce(lambda out, names: out.when(plain.isin(names), of(names)), GIVEN.values(), F.when(F.lit(False), m)).otherwise(m)
    return F.when(F.upper(m) == m, F.upper(name)).when(F.lower(m) == m, F.lower(name)).otherwise(name)


def _surname(m: Column, seed: Column) -> Column:
    """A name for each part of ``m``, a part of one letter kept, with the separators, endings and case of ``m``."""

    def part(p: Column, i: Column) -> Column:
        ending = F.regexp_extract(F.lower(p), "(?<=.)(" + "|".join([*FEMININE, *MASCULINE]) + ")$", 1)

        def of(syllables: list[str], n: int) -> Column:
            names = F.array(*map(F.lit, syllables))
            return F.concat(*[F.element_at(names, _pick(F.xxhash64(seed, i, F.lit(j)), len(syllables)) + 1) for j in range(n)])

        name = F.when(p.rlike(r"\p{IsCyrillic}"), F.when(ending == "", of(SYLLABLES["cyrillic"], 4)).otherwise(F.concat(of(SYLLABLES["cyrillic"], 3), F.regexp_replace(ending, "^", "н"))))
        for script in ("greek", "armenian"):
            name = name.when(p.rlike(rf"\p{{Is{script.capitalize()}}}"), of(SYLLABLES[script], 4))
        name = name.otherwise(of(SYLLABLES["latin"], 4))
        cased = F.when((F.upper(p) == p) & (F.length(p) > 1), F.upper(name)).when(F.lower(p) == p, name).otherwise(F.initcap(name))
        return F.when(p.rlike(r"^\p{L}{2,}"), cased).otherwise(p)

    return F.array_join(F.transform(F.regexp_extract_all(m, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0)), part), "")


def surrogate(key: str, m: Column, attempt: Column) -> Column:
    """What stands for the entity ``m``; ``attempt`` is 0 unless that collides."""

    def of(b: Column) -> Column:
        kind, seed = b["kind"], b["seed"]
        octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_pick(F.xxhash64(seed, i), 254) + 1).cast("string")), ".")
        return (
            F.when(kind == "given", _given_name(key, m))
            .when(kind == "surname", _surname(m, seed))
            .when(kind == "ip", octets)
            .when(kind == "card", _card(m, _substitute(kind, m, seed)))
            .when(kind == "iban", _iban(m, _substitute(kind, m, seed)))
            .otherwise(_substitute(kind, m, seed))
        )

    def seeded(kind: Column) -> Column:
        return let(F.struct(kind.alias("kind"), F.xxhash64(F.lit(key), kind, identity(kind, m), attempt).alias("seed")), of)

    return let(entity_type(m), seeded)


def entities(text: Column) -> Column:
    """All matches of PATTERN in a text, in order; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), F.array().cast("array<string>"))


def names_of(found: Column) -> Column:
    """The distinct names among the entities of a text, in lower case, the longest first."""
    names = F.transform(F.filter(found, lambda m: entity_type(m).isin("given", "surname") & (F.length(m) > 1)), F.lower)
    by_length = F.array_sort(F.transform(F.array_distinct(names), lambda n: F.struct((-F.length(n)).alias("l"), n.alias("n"))))
    return F.transform(by_length, lambda s: s["n"])


def pattern_with(names: Column) -> Column:
    """PATTERN, and last the names wherever they are whole words; names hold nothing but letters, ' and -."""
    return F.concat(F.lit(PATTERN[:-1] + r"|(?=\p{Lu})(?iu:"), F.array_join(names, "|"), F.lit(r")(?![\p{L}\p{N}]))"))


def collision_attempts(found: DataFrame, key: str, most_rounds: int = 50) -> DataFrame:
    """(kind, same, attempt) for the entities of ``found`` (kind, same, m: one spelling) that need an attempt other than 0."""
    tried = found.withColumn("attempt", F.lit(0))
    for _ in range(most_rounds):
        made = tried.withColumn("new", surrogate(key, F.col("m"), F.col("attempt"))).withColumn("new", identity(F.col("kind"), F.col("new")))
        made = stored(made, "surrogates")
        movable = made.where("kind <> 'given'")
        taken = movable.join(found.select("kind", F.col("same").alias("new")).distinct(), ["kind", "new"], "left_semi").select("kind", "same")
        first = movable.groupBy("kind", "new").agg(F.min("same").alias("first"), F.count("*").alias("n")).where("n > 1")
        twice = movable.join(first, ["kind", "new"]).where("same <> first").select("kind", "same")
        again = taken.unionByName(twice).distinct().withColumn("more", F.lit(1))
        if again.isEmpty():
            break
        tried = made.drop("new").join(again, ["kind", "same"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("more", F.lit(0))).drop("more")
    else:
        raise RuntimeError("surrogates did not become distinct")
    return made.where("attempt > 0").select("kind", "same", "attempt")


def replace_personal_data(docs: DataFrame, key: str = "change-this-key", text: str = "text", literal_exceptions: int = 2_000) -> DataFrame:
    """``docs`` with surrogates in the column ``text`` and, as ``n_entities``, how many were replaced in each row."""
    matches = docs.select(F.explode(entities(F.col(text))).alias("m")).groupBy("m").agg(F.count("*").alias("n"))
    kind = entity_type(F.col("m"))
    found = stored(matches.withColumn("kind", kind).withColumn("same", identity(F.col("kind"), F.col("m"))).groupBy("kind", "same").agg(F.min("m").alias("m")), "entities")
    exceptions = stored(collision_attempts(found, key), "exceptions")
    rows = exceptions.limit(literal_exceptions + 1).collect()
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own = {n: f"c{i}" for i, n in enumerate(names)}
    t = F.col(own[text])
    if len(rows) <= literal_exceptions:
        known = F.create_map(*[F.lit(x) for r in rows for x in (f"{r['kind']} {r['same']}", r["attempt"])]) if rows else None
        attempt = lambda m: F.coalesce(F.element_at(known, F.concat_ws(" ", entity_type(m), identity(entity_type(m), m))), F.lit(0)) if rows else F.lit(0)
        work = plain
    else:
        which = F.concat_ws(" ", "kind", "same")
        of_text = plain.select(F.xxhash64(t).alias("text_key"), F.explode(F.array_distinct(entities(t))).alias("m")).withColumn("kind", entity_type(F.col("m")))
        of_text = of_text.withColumn("same", identity(F.col("kind"), F.col("m"))).join(exceptions, ["kind", "same"]).select("text_key", which.alias("which"), "attempt").distinct()
        of_text = of_text.groupBy("text_key").agg(F.map_from_entries(F.collect_list(F.struct("which", "attempt"))).alias("known"))
        work = plain.withColumn("text_key", F.xxhash64(t)).join(of_text, "text_key", "left")
        attempt = lambda m: F.coalesce(F.element_at(F.col("known"), F.concat_ws(" ", entity_type(m), identity(entity_type(m), m))), F.lit(0))
    # Pieces between the matches, and the matches: one more piece than matches, since an empty match is not possible.
    work = work.withColumn("first", entities(t)).withColumn("names", names_of(F.col("first")))
    named = F.size("names") > 0
    work = work.withColumn("pattern", F.when(named, pattern_with(F.col("names"))))
    work = work.withColumn("found", F.when(named, F.regexp_extract_all(t, F.col("pattern"), F.lit(0))).otherwise(F.col("first")))
    pieces = F.when(named, F.split(t, F.col("pattern"), -1)).otherwise(F.split(t, PATTERN, -1))
    new = F.transform("found", lambda m: surrogate(key, m, attempt(m)))
    whole = F.array_join(F.flatten(F.zip_with(pieces, new, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    work = work.withColumns({own[text]: F.when(F.size("found") > 0, whole).otherwise(t), "count": F.size("found").cast("long")})
    if "n_chars" in names:
        n = own["n_chars"]
        work = work.withColumn(n, F.when(F.col("count") > 0, F.length(own[text])).otherwise(F.col(n)).cast(docs.schema["n_chars"].dataType))
    return work.select(*[F.col(c).alias(n) for n, c in own.items()], *([F.col("count").alias("n_entities")] if "n_entities" not in names else []))
