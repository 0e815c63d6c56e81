"""PII: entities are found and replaced by keyed surrogates of the same type and format.

E-mail and IP addresses, phone, card and account numbers (IBAN), identity numbers, hexadecimal
secrets, access tokens and titled names are found by pattern. Each distinct entity (type and
canonical form: case and punctuation do not count, but in tokens they do) has one surrogate in the
whole corpus, drawn from SHA-512 of a key, so every mention of it reads the same. A mention keeps
its own format: punctuation, grouping and case; a card number that passes the Luhn check and an
IBAN keep passing, a token keeps its public prefix. A name's words have a stem each in their script
(Latin, Cyrillic, Greek), which takes the ending of the title's gender, so Mr and Mrs Smith share
it; initials are moved along the alphabet; a later mention of such a word in the document, with or
without a title, is replaced as well. Two entities never share a surrogate and none gets one that
is itself an entity of the corpus: what collides draws again, and a form that has been drawn in
vain for long (but for numbers) is drawn longer.

Everything runs as DataFrame expressions. Texts without an entity are only scanned; entities
travel without their texts, each distinct one is drawn once, and an entity that is mentioned in
a third of all documents is a small row to be joined with them.

Results in odd cases: a null or empty text stays as it is; rows that repeat an id are told
apart by the hash of their text; a null id is a value like any other; very long texts are
searched whole; ties in a collision go to the canonical form that sorts first; numbers of which
so many are entities that ``ATTEMPTS`` draws leave one without a surrogate raise an error that
names their type; extra columns pass through; an empty table gives an empty table. A name is only
found where a document gives it a title once.
"""

from __future__ import annotations

from functools import reduce
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_step, settle

#: Titles that tell a gender (fixed values).
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Signor", "Господин", "Κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mademoiselle", "Señora", "Señorita", "Signora", "Госпожа", "Κυρία"]
#: Parts from which names are made: (syllables, male ending, female ending) of each script.
SCRIPTS = {
    "cyrillic": ("ба ве ди ро ла ми на по се та ру ка же ло ни го", "н", "на"),
    "greek": ("βα γε δι θω λα μι νε πο ρη σα τυ κω φι χα ζε ξα", "ς", "να"),
    "latin": ("ba ve di ro la mi na po se ta ru ka ge lo ni du", "n", "na"),
}
#: Capital letters along which initials move.
ALPHABETS = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]
#: Public beginnings of access tokens (fixed values).
PREFIX = r"(?:AKIA|ASIA|[spr]k[-_]|gh[pousr]_|xox[baprs]-|eyJ)"
#: Draws after which a number without a surrogate is an error; draws between two lengths of a form.
ATTEMPTS, LONGER = 48, 3
_NUMBER = r"(?<![\d.+-])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_GROUP = r"[0-9A-Fa-f]{1,4}"
_WORD = r"(?:\p{Lu}\p{L}*(?:['’-]\p{Lu}\p{L}*)++|\p{Lu}\p{L}+)"
_TITLE = "(?:" + "|".join(MALE + FEMALE) + ")"
#: The first pattern that matches at a place decides the type. Groups that repeat without end do so
#: possessively: a long run is then a loop for the matcher, and no recursion.
PATTERNS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.){1,5}[A-Za-z]{2,24}(?![\w-])",
    "ipv6": rf"(?<![\w:])(?:(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}:){{2,6}}:(?:{_GROUP}(?::{_GROUP}){{0,4}})?)(?![\w:])",
    "ip": _NUMBER + rf"(?:{_OCTET}\.){{3}}{_OCTET}(?![\d]|\.\d)",
    "identity": _NUMBER + r"\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": _NUMBER + r"(?:(?:\d{4}[ -]){3}\d{4}(?![\d-])|\d{13,19}(?!\d))",
    "phone": r"(?<![\w+])(?:\+\d(?:[ .-]?\(?\d\)?){7,14}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4}|0\d{2,4}[ -]\d{3,4}[ -]?\d{3,4})(?!\w)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2} ?[A-Z0-9]{4}(?: ?\d{4}){2,6}(?: ?[A-Z0-9]{1,4}){0,2}(?![A-Za-z0-9])",
    "token": rf"(?<![A-Za-z0-9_-])(?:A[KS]IA[0-9A-Z]{{16}}|[spr]k[-_][A-Za-z0-9_-]{{16,}}|gh[pousr]_[A-Za-z0-9]{{20,}}|xox[baprs]-[A-Za-z0-9-]{{10,}}|eyJ[A-Za-z0-9_-]{{8,}}(?:\.[A-Za-z0-9_-]{{4,}}){{2}})(?![A-Za-z0-9_-])",
    "secret": r"(?<![A-Za-z0-9])[0-9a-fA-F]{32,}(?![A-Za-z0-9])",
    "name": rf"(?<![\p{{L}}]){_TITLE}\.?(?: (?!{_TITLE}(?!\p{{L}}))(?:\p{{Lu}}\.|{_WORD}))++",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_DIGITS = ["phone", "card", "identity"]
_LETTERS, _NUMERALS, _HEX = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
#: Between letters and anything else.
_EDGE = r"(?<=\p{L})(?!\p{L})|(?<!\p{L})(?=\p{L})"


def kind_of(mention: Column) -> Column:
    """Type of a mention, by its shape alone."""
    shape = lambda k, p: F.when(mention.rlike(f"^(?:{p})$"), F.lit(k))
    digits = F.length(F.regexp_replace(mention, r"\D", ""))
    tests = [shape("email", r"[^@ ]+@[^@ ]+"), shape("ip", r"\d{1,3}(?:\.\d{1,3}){3}"), shape("identity", r"\d{3}-\d{2}-\d{4}"), shape("ipv6", r"[0-9A-Fa-f:]*:[0-9A-Fa-f:]*"), shape("token", PREFIX + r"[\w.-]+"), shape("name", r"\p{L}+\.? .*"), shape("iban", r"[A-Z]{2}\d{2}.*"), shape("secret", r"[0-9a-fA-F]{32,}"), F.when((digits >= 13) & mention.rlike(r"^\d"), F.lit("card"))]
    return F.coalesce(*tests, F.lit("phone"))


def canonical_of(kind: Column, mention: Column) -> Column:
    """What mentions of one entity have in common."""
    return F.when(kind.isin(*_DIGITS), F.regexp_replace(mention, r"\D", "")).when(kind == "token", mention).when(kind == "iban", F.replace(mention, F.lit(" "))).otherwise(F.lower(mention))


def script_of(word: Column) -> Column:
    return F.when(word.rlike(r"^\p{IsCyrillic}"), F.lit("cyrillic")).when(word.rlike(r"^\p{IsGreek}"), F.lit("greek")).otherwise(F.lit("latin"))


def _bytes_of(kind: Column, canonical: Column, attempt: Column, key: str) -> Column:
    """512 hexadecimal digits that key, entity and attempt decide."""
    blocks = [F.sha2(F.concat_ws("|", F.lit(key), kind, canonical, attempt.cast("string"), F.lit(str(k))), 512) for k in range(4)]
    return F.concat(*blocks)


def _byte(hexes: Column, i: Column) -> Column:
    return F.conv(F.substring(hexes, (i % 256 * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _per_character(text: Column, hexes: Column, of) -> Column:
    """``of(character, byte, place)`` for each character, joined."""
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: of(c, _byte(hexes, i), i)), "")


def _pick(letters: str, byte: Column) -> Column:
    return F.substring(F.lit(letters), (byte % len(letters) + 1).cast("int"), F.lit(1))


def _alike(c: Column, b: Column) -> Column:
    """A drawn character of the same class; others stay."""
    return F.when(c.rlike("[a-z]"), _pick(_LETTERS, b)).when(c.rlike("[A-Z]"), _pick(_LETTERS.upper(), b)).when(c.rlike("[0-9]"), _pick(_NUMERALS, b)).otherwise(c)


def _luhn_ok(digits: Column) -> Column:
    n = F.length(digits)
    value = lambda i: F.substring(digits, (n - i).cast("int"), F.lit(1)).cast("int")
    twice = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, twice(value(i))).otherwise(value(i)))
    return total % 10 == 0


def _iban(country: Column, body: Column) -> Column:
    """Country, check digits and body."""
    value = lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97
    rest = F.aggregate(F.split(F.concat(body, country, F.lit("00")), ""), F.lit(0), value)
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), body)


def _surrogate(kind: Column, canonical: Column, hexes: Column, attempt: Column) -> Column:
    """A drawn canonical form of the same type, length and alphabet; of a name, its stem. With
    ``attempt`` forms that have no fixed length grow."""
    more = (attempt / LONGER).cast("int")
    digits = _per_character(canonical, hexes, lambda c, b, i: F.when((i == 0) & (c != "0"), (b % 9 + 1).cast("string")).otherwise((b % 10).cast("string")))
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    checked = F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(body, d.cast("string"))), _luhn_ok), 1)
    card = F.when(_luhn_ok(canonical), checked).otherwise(digits)
    ip = F.concat_ws(".", *[(_byte(hexes, F.lit(k)) % 254 + 1).cast("string") for k in range(4)])
    hexed = _per_character(canonical, hexes, lambda c, b, i: F.when(c.rlike("[0-9a-f]"), _pick(_HEX, b)).otherwise(c))
    ipv6 = F.when(more == 0, hexed).otherwise(F.regexp_replace(F.substring(hexes, 1, 32), "(.{4})(?!$)", "$1:"))
    tail = F.length(canonical) - F.length(F.substring_index(canonical, ".", -1))
    extra = F.array_join(F.transform(F.sequence(F.lit(240), F.lit(255)), lambda i: _pick(_LETTERS, _byte(hexes, i))), "")
    email = F.concat(F.substring(extra, F.lit(1), more), _per_character(F.substring(canonical, F.lit(1), tail), hexes, lambda c, b, i: _alike(c, b)), F.substring_index(canonical, ".", -1))
    public = F.length(F.regexp_extract(canonical, f"^{PREFIX}", 0))
    token = _per_character(canonical, hexes, lambda c, b, i: F.when(i < public, c).otherwise(_alike(c, b)))
    iban = _iban(F.substring(canonical, 1, 2), _per_character(F.substring(canonical, F.lit(5), F.length(canonical)), hexes, lambda c, b, i: _alike(c, b)))
    code = F.greatest(F.length(canonical) - 10, F.lit(0))  # a country code stays
    phone = F.concat(F.substring(canonical, F.lit(1), code), F.substring(digits, code + 1, F.lit(64)))
    made = {"phone": phone, "identity": digits, "card": card, "ip": ip, "ipv6": ipv6, "email": email, "iban": iban, "token": token, "secret": hexed}
    places = F.sequence(F.lit(0), (F.greatest(F.lit(2), F.length(canonical) / 2) + more).cast("int"))
    syllables = lambda parts: F.array_join(F.transform(places, lambda i: F.element_at(F.array(*[F.lit(p) for p in parts]), _byte(hexes, i) % len(parts) + 1)), "")
    made |= {f"name_{script}": syllables(parts.split()) for script, (parts, _, _) in SCRIPTS.items()}
    return reduce(lambda out, k: out.when(kind == k, made[k]), made, F.when(F.lit(False), F.lit("")))


def _ended(script: Column, stem: Column, female: Column) -> Column:
    """A name's stem with the ending of a gender."""
    end = reduce(lambda out, s: out.when(script == s, F.when(female, F.lit(SCRIPTS[s][2])).otherwise(F.lit(SCRIPTS[s][1]))), SCRIPTS, F.when(F.lit(False), F.lit("")))
    return F.concat(stem, end)


def draw(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canonical, surrogate) for distinct entities (kind, canonical): all surrogates of a
    kind distinct and none an entity, as which a stem counts with either ending."""
    originals = entities.select(F.col("kind").alias("kind"), F.col("canonical").alias("form"))
    kind, script = F.col("kind"), F.regexp_extract("kind", "^name_(.*)$", 1)
    forms = F.when(script != "", F.array(*[_ended(script, F.col("surrogate"), F.lit(f)) for f in (False, True)])).otherwise(F.array("surrogate"))
    pending, taken = entities, None
    parts = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for attempt in range(ATTEMPTS):
        # a draw costs more than a row says: it is made once, by as many tasks as there are
        drawn = pending.repartition(parts, "kind", "canonical").withColumn("surrogate", _surrogate(kind, F.col("canonical"), _bytes_of(kind, F.col("canonical"), F.lit(attempt), key), F.lit(attempt)))
        drawn = settle(drawn)
        best = drawn.groupBy("kind", "surrogate").agg(F.min("canonical").alias("best"))
        known = best.select("kind", "surrogate", F.explode(forms).alias("form")).join(originals, ["kind", "form"], "left_semi").select("kind", "surrogate")
        free = best.join(known, ["kind", "surrogate"], "left_anti")
        if taken is not None:
            free = free.join(taken.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        step = settle(drawn.join(free, ["kind", "surrogate"], "left").withColumn("won", F.coalesce(F.col("best") == F.col("canonical"), F.lit(False))))
        drop_step(drawn)
        won = step.where("won").select("kind", "canonical", "surrogate")
        taken = won if taken is None else taken.union(won)
        pending = step.where("not won").select("kind", "canonical")
        if pending.isEmpty():
            return taken
    raise ValueError(f"{ATTEMPTS} draws found no free surrogate for {sorted(r['kind'] for r in pending.select('kind').distinct().collect())}")


def rendered(kind: Column, mention: Column, surrogate: Column) -> Column:
    """A surrogate (of a name's word: with its ending) in the format of a mention."""
    fill = lambda of: F.array_join(F.transform(F.split(mention, of, -1), lambda g, i: F.concat(g, F.substring(surrogate, (i + 1).cast("int"), F.lit(1)))), "")
    letters = F.split(mention, "")
    cased = F.array_join(F.transform(F.split(surrogate, ""), lambda c, i: F.when(F.coalesce(F.get(letters, i), F.lit("")).rlike(r"^\p{Lu}$"), F.upper(c)).otherwise(c)), "")
    name = F.when(mention == F.upper(mention), F.upper(surrogate)).otherwise(F.initcap(surrogate))
    return F.when(kind.isin(*_DIGITS), fill(r"\d")).when(kind == "iban", fill("[A-Z0-9]")).when(kind.isin("email", "secret", "ipv6"), F.when(mention == F.upper(mention), F.upper(surrogate)).otherwise(cased)).when(kind.isin("ip", "token"), surrogate).otherwise(name)


def moved_initial(letter: Column, key: str) -> Column:
    """An initial, moved along its alphabet by as many places as the key says (never none)."""
    by = int(sha256(key.encode()).hexdigest(), 16)
    turned = [a[by % (len(a) - 1) + 1 :] + a[: by % (len(a) - 1) + 1] for a in ALPHABETS]
    return F.translate(letter, "".join(ALPHABETS), "".join(turned))


def replace_entities(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in the text column, plus ``pii__count`` (long), the mentions found
    by pattern, and ``pii__kinds`` (their types, distinct and sorted)."""
    text, row = F.col(f"`{text_col}`"), ["pii__of", "pii__as"]
    found = docs.select(F.col(f"`{id_col}`").alias(row[0]), F.xxhash64(text).alias(row[1]), F.regexp_extract_all(text, F.lit(_ANY), F.lit(0)).alias("m")).where(F.size("m") > 0).distinct()
    mentions = found.select(*row, F.posexplode("m").alias("pos", "mention")).withColumn("kind", kind_of(F.col("mention")))
    # a name's words are entities of their own; its title is none, nor is an initial
    female = F.regexp_extract("mention", r"^\p{L}+", 0).isin(*FEMALE)
    own = F.regexp_extract_all("mention", F.lit(r"\p{L}+"), F.lit(0))
    parts = F.when(F.col("kind") == "name", F.filter(F.slice(own, 2, F.size(own)), lambda w: F.length(w) > 1)).otherwise(F.array("mention"))
    pieces = mentions.select(*row, "pos", "kind", female.alias("female"), F.explode_outer(parts).alias("part"))
    kind = F.when(F.col("kind") == "name", F.concat(F.lit("name_"), script_of(F.col("part")))).otherwise(F.col("kind"))
    pieces = pieces.select(*row, "pos", kind.alias("kind"), canonical_of(F.col("kind"), F.col("part")).alias("canonical"), "female")
    # of a word with several titles in a document, the first one tells how it reads without
    pieces = settle(pieces.groupBy(*row, "kind", "canonical").agg(F.min_by("female", "pos").alias("female")))
    entities = settle(pieces.where("canonical is not null").select("kind", "canonical").distinct())
    drawn = settle(draw(entities, key))
    entry = F.struct(F.concat(F.substring_index("kind", "_", 1), F.lit(":"), F.col("canonical")).alias("key"), F.struct("surrogate", "female").alias("value"))
    by_row = settle(pieces.join(drawn, ["kind", "canonical"], "left").groupBy(*row).agg(F.map_from_entries(F.collect_list(F.when(F.col("canonical").isNotNull(), entry))).alias("pii__map"), F.array_sort(F.collect_set(F.substring_index("kind", "_", 1))).alias("pii__kinds")))
    drop_step(entities)
    renamed = by_row.select(F.col(row[0]).alias("pii__id"), F.col(row[1]).alias("pii__hash"), "pii__map", "pii__kinds")
    # what is said grows with the corpus: its join is never a broadcast, at no size
    joined = docs.withColumn(row[1], F.xxhash64(text)).join(renamed.hint("merge"), F.col(f"`{id_col}`").eqNullSafe(F.col("pii__id")) & (F.col(row[1]) == F.col("pii__hash")), "left")
    known = F.col("pii__map")

    def word(w: Column, of: Column | None = None) -> Column:
        """A name's word, by the gender of a title or that of the document."""
        hit = F.element_at(known, F.concat(F.lit("name:"), F.lower(w)))
        return F.when(w.rlike(r"^\p{Lu}\p{L}") & hit.isNotNull(), rendered(F.lit("name"), w, _ended(script_of(w), hit["surrogate"], hit["female"] if of is None else of))).otherwise(w)

    def titled(mention: Column) -> Column:
        tokens = F.split(mention, _EDGE)
        of = tokens[0].isin(*FEMALE)
        return F.array_join(F.transform(tokens, lambda t, i: F.when(i == 0, t).when(F.length(t) == 1, moved_initial(t, key)).otherwise(word(t, of))), "")

    def said(mention: Column) -> Column:
        k = kind_of(mention)
        entity = F.element_at(known, F.concat(k, F.lit(":"), canonical_of(k, mention)))
        return F.when(k == "name", titled(mention)).otherwise(rendered(k, mention, entity["surrogate"]))

    plain = lambda gap: F.when(F.array_contains("pii__kinds", "name"), F.array_join(F.transform(F.split(gap, _EDGE), lambda t: word(t)), "")).otherwise(gap)
    every = F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))
    rebuilt = F.array_join(F.zip_with(F.split(text, _ANY, -1), every, lambda gap, m: F.concat(plain(gap), F.when(m.isNull(), F.lit("")).otherwise(said(m)))), "")
    new = F.when(known.isNull(), text).otherwise(rebuilt)
    return joined.select(*[new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], F.when(known.isNull(), F.lit(0)).otherwise(F.size(every)).cast("long").alias("pii__count"), F.coalesce("pii__kinds", F.array().cast("array<string>")).alias("pii__kinds"))


#: Key of the registered query; a user of the operator passes a secret of their own.
QUERY_KEY = "corpus"


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text with surrogates, the number of mentions replaced and their types."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace_entities(docs, QUERY_KEY).select("doc_id", "text", F.col("pii__count").alias("n_entities"), F.col("pii__kinds").alias("kinds"))
