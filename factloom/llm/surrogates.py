"""Operator 4: personal data replaced by keyed surrogates; DataFrame operations only.

Found in whole texts: e-mail addresses, secrets (long hexadecimal strings and known token shapes), IPv4 addresses,
IPv6 addresses with all eight groups, IBANs, social security numbers, telephone numbers (with `+`, or in one of two North
American forms), card and account numbers (13 to 19 digits), persons after a listed title, and where the same text
repeats such a name, with the title or without. Not found: names that a text has without a title only, national numbers
in other forms, postal addresses. Each mention has a canonical form (case, spaces and punctuation put aside; the country
code added to North American numbers; case kept in secrets that are not hexadecimal), so that all mentions of an entity,
however written, get the same surrogate, in the writing of the mention. Patterns are bounded or possessive, so that the
time is linear in the length of a text and no long run of characters is a problem; a mention has 1,500 characters at most.

Surrogates come from SHA-512 of key, kind, canonical form and attempt. They keep the kind's shape: digits stay digits,
letters letters of the same case, hexadecimal stays so; a mail address keeps its top-level domain, a token the letters
that tell its type, a telephone number its `+` and first digit, a card number its first digit and a valid check digit if
it had one, an IBAN its country, and valid check digits likewise;
an address gets octets from 1 to 254; a person keeps the title, gets a name with an ending of the same gender, in the
same script, with as many words.

Collision checks: a surrogate must not be a real entity of the corpus, nor the surrogate of another; the entities for
which it is make another attempt, by joins, until none is left. So distinct entities stay distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# Titles, by gender.
MALE = ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Господин", "Κύριος"]
FEMALE = ["Mrs", "Ms", "Frau", "Madame", "Mademoiselle", "Señora", "Señorita", "Госпожа", "Κυρία"]
# Syllables and endings of surrogate names, by script.
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe fi ga ge gi ha he jo ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi wa we",
    "cyrillic": "ба бе би бо да де ди до га ге ка ке ки ко ла ле ли ло ма ме ми мо на не ни но па пе ра ре ри ро са се си со та те ти то ва ве ви за зе",
    "greek": "βα βε βι βο δα δε δι δο γα γε κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο πα πε ρα ρε ρι ρο σα σε σι σο τα τε τι το ζα ζε",
}
ENDINGS = {
    ("latin", "m"): "rd n rt s lf nd k ro",
    ("latin", "f"): "na lia ra tte sa nia ya la",
    ("cyrillic", "m"): "н р к м слав мир т й",
    ("cyrillic", "f"): "на ла ра ня са лия та ва",
    ("greek", "m"): "ς νος ρης κος λος νης στος δης",
    ("greek", "f"): "να λα ρα νη ρία λη τα κη",
}

NAME = r"\p{Lu}[\p{L}'’-]+(?: \p{Lu}[\p{L}'’-]+){0,2}"
KINDS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,20}+",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-fA-F]{32,64}|(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36})(?![0-9A-Za-z])|(?<![0-9A-Za-z])sk-[A-Za-z0-9]{20,256}+",
    "ipv4": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?!\.?[0-9])",
    "ipv6": r"(?<![0-9A-Za-z:])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![0-9A-Za-z:])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|\+[0-9]{1,3}[ .-]?\(?[0-9]\)?(?:[ .-]?[0-9]{2,4}){3,4}(?![0-9])|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "person": rf"\b(?:{'|'.join(MALE + FEMALE)})\.? {NAME}",
}
HEXADECIMAL = r"\A[0-9a-fA-F]+\z"
#: Letters that tell the type of a token, which its surrogate keeps.
TOKEN_TYPE = r"\A(AKIA|ASIA|gh[pousr]_|sk-)"
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: What every mention holds; cheap to look for. Digits of addresses, numbers and cards stand four at least behind each
#: other, with separators only between them; an IBAN may hold two digits only.
HINT = rf"@|[0-9](?:[ .()-]*+[0-9]){{3}}|[0-9a-fA-F]:[0-9a-fA-F]{{1,4}}:[0-9a-fA-F]|[A-Z]{{2}}[0-9]{{2}}|AKIA|ASIA|sk-|gh[pousr]_|[0-9a-fA-F]{{32}}|(?:{'|'.join(MALE + FEMALE)})"


def _has_mention(text: Column) -> Column:
    return text.rlike(HINT) & text.rlike(ANY)


def _kind(surface: Column) -> Column:
    """The first kind whose pattern is the whole mention; lookarounds hold at the ends of the string."""
    chain = None
    for kind, pattern in KINDS.items():
        is_kind = surface.rlike(rf"\A(?:{pattern})\z")
        chain = F.when(is_kind, kind) if chain is None else chain.when(is_kind, kind)
    return chain.otherwise("card")


def _canonical(kind: Column, surface: Column) -> Column:
    male = surface.rlike(rf"\A(?:{'|'.join(MALE)})\.? ")
    name = F.lower(F.regexp_replace(surface, r"\A\S+ ", ""))
    return (
        F.when(kind.isin("email", "ipv6") | (kind == "secret") & surface.rlike(HEXADECIMAL), F.lower(surface))
        .when(kind == "phone", F.concat(F.when(surface.startswith("+"), "").otherwise("+1"), F.regexp_replace(surface, "[^0-9+]", "")))
        .when(kind.isin("card", "ssn"), F.regexp_replace(surface, "[^0-9]", ""))
        .when(kind == "iban", F.regexp_replace(surface, " ", ""))
        .when(kind == "person", F.concat(F.when(male, "m:").otherwise("f:"), name))
        .otherwise(surface)
    )


def mentions(documents: DataFrame) -> DataFrame:
    """doc_id, row_hash, surface, kind, canon: each way of writing in each document once."""
    found = documents.filter(_has_mention(F.col("text"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))).alias("surface"))
    typed = found.withColumn("kind", _kind(F.col("surface")))
    return typed.withColumn("canon", _canonical(F.col("kind"), F.col("surface"))).dropDuplicates(["doc_id", "row_hash", "surface"])


def _luhn(number: str, upto: str = "0") -> str:
    """The Luhn sum of a string of digits, from the right; the last digit counts as `upto` if that is not 0."""
    digit = f"cast(substr({number}, length({number}) - i, 1) as int)"
    doubled = f"if(i % 2 = 1, if({digit} > 4, 2 * {digit} - 9, 2 * {digit}), {digit})"
    return f"aggregate(sequence({upto}, length({number}) - 1), 0, (n, i) -> n + {doubled})"


def _mod97(iban: str) -> str:
    """The remainder by 97 of an IBAN's text, country and check digits moved behind the rest, letters as numbers from 10."""
    turned = f"concat(substr({iban}, 5), left({iban}, 4))"
    value = "if(c BETWEEN '0' AND '9', cast(c as int), ascii(c) - 55)"
    return f"aggregate(split({turned}, ''), 0, (n, c) -> (n * if(c BETWEEN '0' AND '9', 10, 100) + {value}) % 97)"


def _draw(table: DataFrame, key: str) -> DataFrame:
    """table(kind, canon, attempt) with `surrogate`, in canonical form."""
    pick = "cast(conv(substr(h, (i % 32) * 4 + 1, 4), 16, 10) as int) + 7 * cast(i / 32 as int)"
    digit, letter = "substr('0123456789', 1 + ({p}) % 10, 1)".format(p=pick), "substr('abcdefghijklmnopqrstuvwxyz', 1 + ({p}) % 26, 1)".format(p=pick)
    hexes, upper = "substr('abcdef', 1 + ({p}) % 6, 1)".format(p=pick), "upper({})".format(letter)
    plain = f"CASE WHEN c BETWEEN '0' AND '9' THEN {digit} WHEN c BETWEEN 'a' AND 'z' THEN {{}} WHEN c BETWEEN 'A' AND 'Z' THEN {upper} ELSE c END"
    chars = "array_join(transform(split(canon, ''), (c, i) -> CASE WHEN {keep} THEN c ELSE {plain} END), '')".format
    first = "substr('23456789', 1 + ({p}) % 8, 1)".format(p=pick)
    tail = "length(substring_index(canon, '.', -1))"
    card = chars(keep="i = 0", plain=plain.format(letter))
    hashed = table.withColumn("h", F.sha2(F.concat_ws("|", F.lit(key), "kind", "canon", F.col("attempt").cast("string")), 512))
    words = "split(substr(canon, 3), ' ')"
    script = "CASE WHEN canon RLIKE '[\\u0400-\\u04FF]' THEN 'cyrillic' WHEN canon RLIKE '[\\u0370-\\u03FF]' THEN 'greek' ELSE 'latin' END"
    listed = lambda text: "split('" + text + "', ' ')"
    by_script = "CASE " + " ".join(f"WHEN script = '{s}' THEN {listed(v)}" for s, v in SYLLABLES.items()) + " END"
    by_gender = "CASE " + " ".join(f"WHEN script = '{s}' AND left(canon, 1) = '{g}' THEN {listed(v)}" for (s, g), v in ENDINGS.items()) + " END"
    at = "cast(conv(substr(h, ((w * 4 + {k}) % 32) * 4 + 1, 4), 16, 10) as int)".format
    part = lambda k: f"syllables[{at(k=k)} % size(syllables)]"
    # names get longer with the attempts, so that there are always enough
    longer = f"array_join(transform(sequence(0, cast(attempt / 3 as int)), j -> if(j = 0, '', syllables[({at(k='j')} + j) % size(syllables)])), '')"
    name = f"concat(left(canon, 2), array_join(transform({words}, (x, w) -> concat({part(0)}, {part(1)}, {part(2)}, {longer}, endings[{at(k=3)} % size(endings)])), ' '))"
    hashed = hashed.withColumn("prefix", F.regexp_extract("canon", TOKEN_TYPE, 1))
    hashed = hashed.withColumn("script", F.expr(script)).withColumn("syllables", F.expr(by_script)).withColumn("endings", F.expr(by_gender))
    octets = "array_join(transform(sequence(0, 3), i -> cast(1 + (" + pick + ") % 254 as string)), '.')"
    phone_keep = "c = '+' OR (i = 1 AND left(canon, 1) = '+')"
    phone = f"array_join(transform(split(canon, ''), (c, i) -> CASE WHEN {phone_keep} THEN c WHEN i IN (0, 2) THEN {first} ELSE {digit} END), '')"
    drawn = hashed.withColumn(
        "surrogate",
        F.when(F.col("kind") == "email", F.expr(chars(keep=f"i >= length(canon) - {tail}", plain=plain.format(letter))))
        .when(F.col("kind") == "secret", F.expr(chars(keep="i < length(prefix)", plain=plain.format(f"if(canon RLIKE '^[0-9a-f]+$', {hexes}, {letter})"))))
        .when(F.col("kind") == "ipv6", F.expr(chars(keep="false", plain=plain.format(hexes))))
        .when(F.col("kind") == "ipv4", F.expr(octets))
        .when(F.col("kind") == "iban", F.expr(chars(keep="i < 2", plain=plain.format(letter))))
        .when(F.col("kind") == "phone", F.expr(phone))
        .when(F.col("kind") == "person", F.expr(name))
        .when(F.col("kind") == "card", F.expr(card))
        .otherwise(F.expr(chars(keep="false", plain=plain.format(letter)))),
    )
    valid = F.expr(_luhn("canon") + " % 10") == 0
    fixed = F.expr(f"concat(left(surrogate, length(surrogate) - 1), cast((10 - {_luhn('surrogate', '1')} % 10) % 10 as string))")
    proven = F.expr(_mod97("canon")) == 1
    unproven = "concat(left(surrogate, 2), '00', substr(surrogate, 5))"
    proved = F.expr(f"concat(left(surrogate, 2), lpad(cast(98 - {_mod97(unproven)} as string), 2, '0'), substr(surrogate, 5))")
    made = F.when((F.col("kind") == "card") & valid, fixed).when((F.col("kind") == "iban") & proven, proved).otherwise(F.col("surrogate"))
    return drawn.withColumn("surrogate", made).select("kind", "canon", "attempt", "surrogate")


def resolve(entities: DataFrame, key: str, idle: int = 20) -> DataFrame:
    """entities(kind, canon) -> kind, canon, surrogate, all surrogates of a kind distinct and none of them an entity.

    Each round the entities without one draw; those stay without whose draw is an entity, is taken, or was drawn by a
    smaller canonical form too. Goes on until all have one; raises only if `idle` rounds give none to anybody, as when
    a kind of fixed length has hardly more values than entities.
    """
    real = entities.select("kind", F.col("canon").alias("surrogate"))
    waiting, taken, without = entities.withColumn("attempt", F.lit(0)), None, 0
    while True:
        drawn = common.saved(_draw(waiting, key), "drawn")
        lowest = drawn.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon"))
        good = lowest.join(real, ["kind", "surrogate"], "left_anti")
        if taken is not None:
            good = good.join(taken.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        good = common.saved(good.select("kind", "canon", "surrogate"), "settled")
        without = without + 1 if good.isEmpty() else 0
        taken = good if taken is None else taken.unionByName(good)
        waiting = drawn.join(good, ["kind", "canon"], "left_anti").select("kind", "canon", (F.col("attempt") + 1).alias("attempt"))
        if waiting.isEmpty():
            return taken
        if without >= idle:
            raise ValueError("too few surrogates of some shape for the entities that have it")


def _render(kind: Column) -> Column:
    """The surrogate in the writing of the mention."""
    # a national number is the end of its canonical form
    spread = F.expr("aggregate(split(surface, ''), named_struct('k', 1 + length(surrogate) - length(regexp_replace(surface, '[^0-9A-Za-z+]', '')), 's', ''), (a, c) -> if(c RLIKE '[0-9A-Za-z+]', named_struct('k', a.k + 1, 's', concat(a.s, substr(surrogate, a.k, 1))), named_struct('k', a.k, 's', concat(a.s, c))), a -> a.s)")
    cased = F.expr("array_join(transform(split(surrogate, ''), (c, i) -> if(substr(surface, i + 1, 1) RLIKE '[A-Z]', upper(c), c)), '')")
    title, name = F.regexp_extract("surface", r"\A(\S+ )", 1), F.regexp_replace("surface", r"\A\S+ ", "")
    new = F.initcap(F.expr("substr(surrogate, 3)"))
    person = F.concat(title, F.when(name == F.upper(name), F.upper(new)).otherwise(new))
    return F.when(kind.isin("email", "ipv6") | (kind == "secret") & F.col("surface").rlike(HEXADECIMAL), cased).when(kind == "secret", F.col("surrogate")).when(kind == "person", person).when(kind == "ipv4", F.col("surrogate")).otherwise(spread)


#: What must not stand next to a name for it to be a whole one.
_LETTER = r"[\p{L}\p{N}_'’-]"


def pseudonymised(documents: DataFrame, key: str = "surrogate-key-1") -> DataFrame:
    """documents with the mentions in `text` replaced, and n_replaced; all other columns as they are.

    Texts without mentions stay as they are, a null text stays null, and repeated rows are treated alike; texts may be of
    any length. The same key and entities give the same surrogates. A column n_replaced is overwritten. No rows: none.
    """
    columns = [c for c in documents.columns if c != "n_replaced"]
    met = common.saved(mentions(documents), "mentions")
    mapping = common.saved(resolve(common.saved(met.select("kind", "canon").distinct(), "entities"), key), "mapping")
    written = met.join(common.broadcast_if_small(mapping, 200_000), ["kind", "canon"]).select("doc_id", "row_hash", "kind", "surface", _render(F.col("kind")).alias("rendered"))
    bare = F.when(F.col("kind") == "person", F.struct(F.regexp_replace("surface", r"\A\S+ ", "").alias("name"), F.regexp_replace("rendered", r"\A\S+ ", "").alias("new")))
    maps = written.groupBy(F.col("doc_id").alias("_map_id"), F.col("row_hash").alias("_map_hash")).agg(F.map_from_entries(F.collect_list(F.struct("surface", "rendered"))).alias("_map"), F.collect_set(bare).alias("_names"))
    maps = common.broadcast_if_small(common.saved(maps, "document-maps"), 100_000)
    base = documents.select(F.struct(*columns).alias("_row"), "text", F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash"))
    joined = base.join(maps, base["_id"].eqNullSafe(maps["_map_id"]) & (base["_hash"] == maps["_map_hash"]), "left")
    hits, gaps = F.regexp_extract_all("text", F.lit(ANY), F.lit(0)), F.split("text", ANY, -1)
    # between the mentions, names that the text has with a title elsewhere; longer names first
    names = F.array_sort("_names", lambda x, y: F.length(y["name"]) * 1000 - F.length(x["name"]) * 1000 + F.when(x["name"] < y["name"], -1).when(x["name"] > y["name"], 1).otherwise(0))
    pattern = lambda e: F.concat(F.lit(rf"(?<!{_LETTER})"), e["name"], F.lit(rf"(?!{_LETTER})"))
    step = lambda a, e: F.struct(F.regexp_replace(a["t"], pattern(e), e["new"]).alias("t"), (a["n"] + F.regexp_count(a["t"], pattern(e))).alias("n"))
    swapped = lambda gap: F.aggregate("_sorted", F.struct(gap.alias("t"), F.lit(0).alias("n")), step)
    cut = joined.withColumn("_sorted", names).withColumn("_hits", F.when(F.col("_map").isNotNull(), hits))
    cut = cut.withColumn("_gaps", F.when(F.col("_map").isNotNull() & (F.size("_sorted") > 0), F.transform(gaps, swapped)).when(F.col("_map").isNotNull(), F.transform(gaps, lambda g: F.struct(g.alias("t"), F.lit(0).alias("n")))))
    rebuilt = F.array_join(F.flatten(F.zip_with("_gaps", "_hits", lambda g, h: F.array(g["t"], F.when(h.isNull(), "").otherwise(F.element_at("_map", h))))), "")
    again = F.aggregate("_gaps", F.lit(0), lambda n, g: n + g["n"])
    text = F.when(F.col("_map").isNull(), F.col("text")).otherwise(rebuilt)
    count = F.when(F.col("_map").isNull(), 0).otherwise(F.size("_hits") + again)
    return cut.select(*[text.alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in columns], count.alias("n_replaced"))
