"""Personal data replaced by keyed surrogates."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# Titles that give a name's gender, and given names by gender and script.
TITLES = {"m": "Mr|Herr|Señor|Sr|Monsieur|Don|Г-н|Господин|Κύριος".split("|"), "f": "Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|Doña|Г-жа|Госпожа|Κυρία".split("|")}
GIVEN = {
    ("m", "latin"): "James John Robert Michael David Thomas Daniel Paul Peter Martin Lukas Pierre Jean Carlos Miguel Pablo".split(),
    ("f", "latin"): "Mary Anna Linda Susan Karen Laura Sarah Julia Emma Sophie Marie Claire Carmen Lucia Elena Ines".split(),
    ("m", "cyrillic"): "Иван Пётр Олег Павел Андрей Сергей Борис Максим".split(),
    ("f", "cyrillic"): "Анна Мария Ольга Елена Ирина Наталья Вера Татьяна".split(),
    ("m", "greek"): "Νίκος Γιώργος Πέτρος Κώστας".split(),
    ("f", "greek"): "Μαρία Ελένη Άννα Σοφία".split(),
}
SYLLABLES = {"latin": "ba ren dol mi tar sen vo lin gar pel ro wick".split(), "cyrillic": "ба рен дол ми тар сен во лин гар пел ро ник".split(), "greek": "βα ρεν δολ μι ταρ σεν βο λιν γαρ πελ ρο νικ".split()}

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_ALL_GIVEN = "|".join(x for names in GIVEN.values() for x in names)
#: Every pattern starts where a word can't have begun before, so a text is read in time linear in its length.
PATTERNS = {
    "email": r"(?<![\p{L}0-9._%+\-])[\p{L}0-9._%+\-]{1,64}@[\p{L}0-9\-]{1,63}(?:\.[\p{L}0-9\-]{1,63}){1,8}",
    "access_key": r"(?<![A-Za-z0-9])A(?:KIA|SIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}[ .\-]?\(?[0-9]{1,4}\)?(?:[ .\-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9(])(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9A-Za-z])",
    "hex": r"(?<![0-9A-Za-z])(?=[a-f]*+[0-9])[0-9a-f]{32,}+(?![0-9A-Za-z])",
    "secret": r"""(?<=(?i:password|passwd|pwd|secret|token|api_?key)["']?\s{0,2}[=:]\s{0,2}["']?)(?![\s"'=:])[^\s"',;]{6,}+""",
    "name": rf"(?=\p{{Lu}})(?<!\p{{L}})(?:(?:{'|'.join(TITLES['m'] + TITLES['f'])})\.? \p{{Lu}}\p{{L}}{{1,40}}(?: \p{{Lu}}\p{{L}}{{1,40}}(?![\p{{L}}0-9]))?|(?:{_ALL_GIVEN}) \p{{Lu}}\p{{L}}{{1,40}})(?![\p{{L}}0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every pattern needs; texts without it are not looked at further.
HINT = rf"[0-9@]|A(?:KIA|SIA)|(?i:password|passwd|pwd|secret|token|api_?key)|(?=\p{{Lu}})(?<!\p{{L}})(?:(?:{'|'.join(TITLES['m'] + TITLES['f'])})\.? |(?:{_ALL_GIVEN}) )"
#: Stand before and after each entity of a text once it has been found; a text that has the first of them is read twice instead.
MARK, MARKS = "\ue0f1", "\ue0f1\ue0f2\ue0f1"
#: Bytes of a stream, which a longer surface takes again from the start; a surface of more characters than LONG is no
#: number, so its digits are told by their place and not counted from the right; and draws in which a format is kept
#: strictly: what still meets others then, as where a format has fewer surrogates than entities, grows by a character
#: every STEP draws.
STREAM, LONG, DRAWS, STEP = 256, 128, 8, 2
#: Draws in which a given name comes from the lists, before it is made of syllables.
LISTED = 4
#: Draws after which something else must be wrong: by then a surrogate has grown by some 25 characters.
MOST_DRAWS = 60


def kind_of(surface: Column) -> Column:
    """The first pattern that the whole surface matches; what only its surroundings make an entity is a secret."""
    out = F.lit("secret")
    for kind in reversed([k for k in PATTERNS if k != "secret"]):
        out = F.when(surface.rlike(f"^(?:{PATTERNS[kind]})$"), kind).otherwise(out)
    return out


def canonical(kind: Column, surface: Column) -> Column:
    """What two surfaces of one entity share: the digits of a number (the last ten of a phone's), an address in lower
    case, a name's last word in lower case (its given name is an entity of its own)."""
    digits = F.regexp_replace(surface, "[^0-9]", "")
    return (
        F.when(kind == "phone", F.substring(digits, F.greatest(F.lit(1), F.length(digits) - 9), F.lit(10)))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "email", F.lower(surface))
        .when(kind == "iban", F.regexp_replace(surface, " ", ""))
        .when(kind == "name", F.lower(F.regexp_extract(surface, r"(\p{L}+)$", 1)))
        .otherwise(surface)
    )


def _stream(key: str, kind: Column, name: Column, draw: Column) -> Column:
    return F.concat(*[F.sha2(F.concat_ws("\x1f", F.lit(key), kind, name, draw.cast("string"), F.lit(str(i))).cast("binary"), 512) for i in range(STREAM // 64)])


def _byte(stream: Column, k: Column) -> Column:
    return F.conv(F.substring(stream, (F.pmod(k, F.lit(STREAM)) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _among(letters: str, n: Column) -> Column:
    return F.substring(F.lit(letters), (F.pmod(n, F.lit(len(letters))) + 1).cast("int"), F.lit(1))


ALPHABETS = (("[a-z]", "abcdefghijklmnopqrstuvwxyz"), ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (r"[\x{0400}-\x{04FF}&&\p{Ll}]", "абвгдежзиклмнопрстуфхцчшэюя"), (r"[\x{0400}-\x{04FF}&&\p{Lu}]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"), (r"[\x{0370}-\x{03FF}&&\p{Ll}]", "αβγδεζηθικλμνξοπρστυφχψω"), (r"[\x{0370}-\x{03FF}&&\p{Lu}]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"), (r"\p{Ll}", "abcdefghijklmnopqrstuvwxyz"), (r"\p{Lu}", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))


def _shaped(surface: Column, stream: Column, hexadecimal: bool = False) -> Column:
    """Digit for digit (counted from the right, so that a number with and without its prefix agree) and letter for
    letter of the same script and case; other characters stay."""

    def one(c, i):
        left = F.when(F.length(surface) > LONG, F.length(surface) - i).otherwise(F.length(F.regexp_replace(F.substring(surface, i + 1, F.lit(LONG)), "[^0-9]", "")))
        n = _byte(stream, i + 64)
        out = c
        for pattern, letters in reversed((("[a-f]", "abcdef"),) if hexadecimal else ALPHABETS):
            out = F.when(c.rlike(f"^{pattern}$"), _among(letters, n)).otherwise(out)
        return F.when(c.rlike("^[0-9]$"), _among("0123456789", _byte(stream, left))).otherwise(out)

    return F.array_join(F.transform(F.split(surface, ""), one), "")


def _more(kind: Column, stream: Column, draw: Column) -> Column:
    """What a surrogate grows by after DRAWS draws: digits for numbers, else letters of hexadecimals."""
    n = F.floor((draw - DRAWS) / STEP + 1).cast("int")
    letters = F.transform(F.sequence(F.lit(1), n), lambda i: F.when(kind.isin("phone", "ssn", "card", "iban"), _among("0123456789", _byte(stream, i + 200))).otherwise(_among("abcdef0123456789", _byte(stream, i + 200))))
    return F.when(draw >= DRAWS, F.array_join(letters, "")).otherwise("")


def _ip(surface: Column, stream: Column, draw: Column) -> Column:
    """Octets of as many digits; after DRAWS draws of any."""

    def octet(x, i):
        n = _byte(stream, i * 2) * 256 + _byte(stream, i * 2 + 1)
        return F.when(draw >= DRAWS, n % 256).when(F.length(x) == 1, 1 + n % 9).when(F.length(x) == 2, 10 + n % 90).otherwise(100 + n % 124).cast("string")

    return F.array_join(F.transform(F.split(surface, r"\."), octet), ".")


def _luhn(digits: Column) -> Column:
    """The Luhn sum mod 10 of a string of digits."""
    return F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))),
        F.lit(0), lambda a, b: a + b) % 10


def _card(surface: Column, shaped: Column, more: Column) -> Column:
    """The first digit stays; a number that passes the Luhn check gives one that does."""
    digits = F.regexp_replace(surface, "[^0-9]", "")
    front = F.concat(F.substring(surface, 1, 1), F.substring(shaped, F.lit(2), F.length(shaped) - 2), more)
    check = (10 - _luhn(F.concat(F.regexp_replace(front, "[^0-9]", ""), F.lit("0")))) % 10
    return F.concat(front, F.when(_luhn(digits) == 0, check.cast("string")).otherwise(F.substring(shaped, -1, 1)))


def _phone(surface: Column, shaped: Column) -> Column:
    """A country code stays, and so does the exchange 555 that is kept for made-up numbers."""
    code = F.regexp_extract(surface, r"^(\+[0-9]{1,3}(?=[ .\-(]))", 1)
    rest = F.substring(shaped, F.length(code) + 1, F.lit(64))
    return F.concat(code, F.when(surface.rlike(r"[) .\-]555[ .\-]"), F.regexp_replace(rest, r"([) .\-])[0-9]{3}([ .\-][0-9]{4})$", "$1555$2")).otherwise(rest))


def _email(surface: Column, shaped: Column, stream: Column, more: Column) -> Column:
    """Names and sub-domains keep their shape; the domain becomes one of those kept for examples."""
    domain = F.regexp_extract(surface, r"([^.@]+\.[^.@]+)$", 1)
    end = F.concat(F.lit("example."), F.element_at(F.array(*map(F.lit, ("com", "org", "net"))), _byte(stream, F.lit(63)) % 3 + 1))
    kept = F.when(domain.rlike(r"^(?i:example\.(?:com|org|net))$"), domain).otherwise(end)
    return F.concat(more, F.substring(shaped, F.lit(1), F.length(surface) - F.length(domain)), kept)


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"[\x{0400}-\x{04FF}]"), "cyrillic").when(word.rlike(r"[\x{0370}-\x{03FF}]"), "greek").otherwise("latin")


def _part(listed: Column, many: int, stream: Column, i: Column) -> Column:
    return F.element_at(listed, _byte(stream, i) % many + 1)


def _syllables(word: Column, stream: Column, n: Column, end: Column | None = None) -> Column:
    """A made-up word of n syllables of the word's script."""
    out = F.lit(None).cast("string")
    for script, parts in SYLLABLES.items():
        listed = F.array(*map(F.lit, parts))
        made = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), partial(_part, listed, len(parts), stream)), "")
        out = F.when(_script(word) == script, made).otherwise(out)
    return F.initcap(out if end is None else F.concat(out, end))


def _surname(word: Column, stream: Column, draw: Column) -> Column:
    """Four syllables of the word's script, and one more each draw."""
    return _syllables(word, stream, draw + 4)


_TITLE = rf"^((?:{'|'.join(TITLES['m'] + TITLES['f'])})\.? )"


def _given(surface: Column) -> Column:
    """The given name of a name's surface; null where there is only a last name."""
    rest = F.regexp_replace(surface, _TITLE, "")
    return F.when(rest.contains(" "), F.substring_index(rest, " ", 1))


def person(surface: Column) -> Column:
    """What a name's given name is known by: last name, given name and gender, which its title tells or else the given name
    itself. Null where there is only a last name."""
    title = F.regexp_extract(surface, r"^([^. ]+)\.? ", 1)
    women = F.array(*[F.lit(x) for (g, _), names in GIVEN.items() if g == "f" for x in names])
    female = F.when(title.isin(TITLES["m"] + TITLES["f"]), title.isin(TITLES["f"])).otherwise(F.array_contains(women, _given(surface)))
    last = F.lower(F.regexp_extract(surface, r"(\p{L}+)$", 1))
    return F.when(_given(surface).isNotNull(), F.concat_ws(" ", last, F.lower(_given(surface)), F.when(female, "f").otherwise("m")))


def _new_given(given: Column, who: Column, stream: Column, draw: Column) -> Column:
    """A listed name of the same gender and script, another than its own; after LISTED draws a made-up one."""
    gender = F.substring(who, -1, 1)
    ends = F.when(_script(given) == "cyrillic", "а").when(_script(given) == "greek", "α").otherwise("a")
    new = F.lit(None).cast("string")
    for (g, script), names in GIVEN.items():
        at = _byte(stream, F.lit(0)) % len(names)
        pick = F.element_at(F.array(*map(F.lit, names)), at + 1)
        pick = F.when(F.lower(pick) == F.lower(given), F.element_at(F.array(*map(F.lit, names)), (at + 1) % len(names) + 1)).otherwise(pick)
        new = F.when((gender == g) & (_script(given) == script), pick).otherwise(new)
    return F.when(draw < LISTED, new).otherwise(_syllables(given, stream, draw - LISTED + 2, F.when(gender == "f", ends).otherwise("")))


def rendered(rows: DataFrame, key: str, out: str) -> DataFrame:
    """Adds `out`: the surrogate of `surface` of the entity (kind, canonical) at `draw`, of the same kind and shape; of a name
    the last name alone, and of a given name (kind `given`) that. What every character is taken from is a column of its
    own, so it is made once for a row."""
    kind, surface, draw = F.col("kind"), F.col("surface"), F.col("draw")
    rows = rows.withColumns({"__stream": _stream(key, kind, F.col("canonical"), draw)})
    stream = F.col("__stream")
    rows = rows.withColumns({
        "__shaped": F.when(surface.rlike("^[0-9a-f]+$") & kind.isin("hex", "secret"), _shaped(surface, stream, True)).when(~kind.isin("name", "given", "ip"), _shaped(surface, stream)),
        "__more": _more(kind, stream, draw),
    })
    shaped, more = F.col("__shaped"), F.col("__more")
    made = (
        F.when(kind == "email", _email(surface, shaped, stream, more))
        .when(kind == "ip", _ip(surface, stream, draw))
        .when(kind == "card", _card(surface, shaped, more))
        .when(kind == "phone", F.concat(_phone(surface, shaped), more))
        .when(kind == "name", _surname(F.regexp_extract(surface, r"(\p{L}+)$", 1), stream, draw))
        .when(kind == "given", _new_given(surface, F.col("canonical"), stream, draw))
        .when(kind == "access_key", F.concat(F.substring(surface, 1, 4), F.substring(shaped, F.lit(5), F.lit(64))))
        .when(kind == "iban", F.concat(F.substring(surface, 1, 2), F.substring(shaped, F.lit(3), F.lit(64)), more))
        .otherwise(F.concat(shaped, more))
    )
    return rows.withColumn(out, made).drop("__stream", "__shaped", "__more")


def draws(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canonical, draw) for each entity (kind, canonical, surface: one of its surfaces).

    Surrogates of draw 0 are made for all; where two entities of a kind meet, or a surrogate is a real entity of its
    kind, all but the first of them draw again, until none is left. Given names meet inside their last name only, and only
    their own is not to be drawn. Every surrogate comes from the key; from DRAWS draws on it grows, so a format that has
    fewer surrogates than entities ends the rounds too.
    """
    left = entities.withColumn("draw", F.lit(0))
    made, real = None, entities.where("kind <> 'given'").select("kind", F.col("canonical").alias("made"))
    for draw in range(MOST_DRAWS):
        tried = rendered(left.withColumn("draw", F.lit(draw)), key, "made")
        within = F.concat_ws(" ", F.substring_index("canonical", " ", 1), F.lower("made"))
        tried = stored(tried.withColumn("made", F.when(F.col("kind") == "given", within).otherwise(canonical(F.col("kind"), F.col("made")))), "surrogates-tried")
        taken = real if made is None else real.unionByName(made.select("kind", "made"))
        first = tried.groupBy("kind", "made").agg(F.min("canonical").alias("__first"))
        free = tried.join(taken.distinct().withColumn("__taken", F.lit(True)), ["kind", "made"], "left").join(first, ["kind", "made"])
        own = (F.col("kind") == "given") & F.col("canonical").startswith(F.concat(F.col("made"), F.lit(" ")))
        free = stored(free.select("kind", "canonical", "surface", "draw", "made", (F.col("__taken").isNull() & ~own & (F.col("canonical") == F.col("__first"))).alias("__good")), "surrogates")
        good, left = free.where("__good").drop("__good"), free.where("not __good").drop("__good", "made")
        made = good if made is None else made.unionByName(good)
        if left.isEmpty():
            return made.select("kind", "canonical", "draw")
    raise RuntimeError(f"{MOST_DRAWS} draws were not enough")


def _marked(text: Column) -> Column:
    """The parts of a text, in turns without an entity and an entity, first and last without one; null where it has none.
    Patterns are run once over a text that has what they need."""
    twice = F.flatten(F.transform(F.arrays_zip(F.split(text, ANY, -1).alias("a"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)).alias("b")), lambda z: F.array(z["a"], z["b"])))
    twice = F.slice(twice, F.lit(1), F.size(twice) - 1)
    once = F.split(F.regexp_replace(text, ANY, f"{MARKS}$0{MARKS}"), MARKS, -1)
    parts = F.when(text.contains(MARK), twice).otherwise(once)
    return F.when(text.rlike(HINT), parts)


def pseudonymise(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """docs with each detected entity in `text` replaced by its surrogate; `count`: also a column with their number.

    Detected are addresses, numbers and keys (PATTERNS), and names after a title or with a known given name. A surrogate
    follows from `key` (which must not be empty), the entity's kind and what its surfaces share, so one entity has one
    surrogate in all documents. A person's last name is one entity and the given name another inside it, so different
    people stay different and `Mr. Smith` is still of the family of `John Smith`; draws() sees to it that different
    entities of a kind have different surrogates and that none is a real one. A surrogate keeps its kind's format, the
    script, and a name's gender.

    Each text is read by the patterns once. Rows get a number and are written, those with an entity apart, cut at their
    entities; the others are only read back. Entities are combined over all rows before they meet, so one that stands in a
    third of the rows is one row. All columns stay, whatever their names; repeated rows, null keys and null or empty texts
    are kept as they are. Whole texts of any length; no rows: no rows.
    """
    if not key:
        raise ValueError("surrogates need a key")
    names = docs.columns
    rest = F.struct(F.lit(0).alias("z"), *[F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(names) if c != text])
    cut = docs.select(rest.alias("rest"), F.col(f"`{text}`").alias("text"), _marked(F.col(f"`{text}`")).alias("parts"))
    some = F.coalesce(F.size("parts") > 1, F.lit(False))
    cut = cut.select("rest", F.when(~some, F.col("text")).alias("text"), F.when(some, F.col("parts")).alias("parts"), some.alias("some"), F.monotonically_increasing_id().alias("row"))
    cut = stored(cut, "personal", "some")
    dirty, clean = cut.where("some"), cut.where("not some")
    found = F.filter("parts", lambda _, i: i % 2 == 1)
    each = dirty.select("row", F.posexplode(found).alias("at", "surface")).withColumn("kind", kind_of(F.col("surface")))
    each = each.withColumns({"canonical": canonical(F.col("kind"), F.col("surface")), "person": F.when(F.col("kind") == "name", person(F.col("surface")))})
    each = stored(each, "entities")
    given = each.where("person is not null").select(F.lit("given").alias("kind"), F.col("person").alias("canonical"), _given(F.col("surface")).alias("surface"))
    entities = each.select("kind", "canonical", "surface").unionByName(given).groupBy("kind", "canonical").agg(F.min("surface").alias("surface"))
    drawn = stored(draws(stored(entities, "entities-once"), key), "surrogates-drawn")
    # each surface is rendered once, not once for each place
    surfaces = stored(each.select("kind", "canonical", "surface", "person").distinct(), "surfaces")
    made = stored(rendered(surfaces.join(drawn, ["kind", "canonical"]), key, "made").drop("draw"), "surrogates-last")
    people = made.where("person is not null").select(F.lit("given").alias("kind"), F.col("person").alias("canonical"), _given(F.col("surface")).alias("surface")).distinct()
    people = stored(rendered(people.join(drawn, ["kind", "canonical"]), key, "new").select(F.col("canonical").alias("person"), F.col("surface").alias("of"), "new"), "surrogates-given")
    whole = made.join(people, (made["person"] == people["person"]) & (_given(made["surface"]) == people["of"]), "left")
    title = F.regexp_extract("surface", _TITLE, 1)
    new = F.when(F.col("kind") == "name", F.concat(title, F.coalesce(F.concat("new", F.lit(" ")), F.lit("")), F.col("made"))).otherwise(F.col("made"))
    whole = stored(whole.select("kind", "surface", new.alias("new")), "surrogates-made")
    placed = each.select("row", "at", "kind", "surface").join(whole, ["kind", "surface"])
    by_row = placed.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "new"))), lambda x: x["new"]).alias("news"))
    joined = dirty.join(by_row, "row")
    text_now = F.array_join(F.transform("parts", lambda x, i: F.when(i % 2 == 1, F.element_at("news", F.floor((i + 1) / 2).cast("int"))).otherwise(x)), "")

    def back(rows: DataFrame, now: Column, number: Column) -> DataFrame:
        columns = [now.alias(c) if c == text else F.col(f"rest.f{i}").alias(c) for i, c in enumerate(names)]
        return rows.select(*columns, *([number.cast("long").alias(count)] if count else []))

    return back(joined, text_now, F.size("news")).unionByName(back(clean, F.col("text"), F.lit(0)))
