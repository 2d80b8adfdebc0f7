"""Personal data replaced by keyed surrogates of the same type, script, gender and format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from presswork.session import durable_table

MALE = "Mr|Herr|Señor|Sr|Monsieur|Sir"
FEMALE = "Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme"
OPEN = "Dr|Prof"
_TITLE = rf"(?:{FEMALE}|{MALE}|{OPEN})"
_GAP = r"[ .#*$%&|!()-]{0,6}"
_NO_WORD = r"(?![\p{L}\p{N}])"
_AFTER_NO_WORD = r"(?<![\p{L}\p{N}])"
#: Titles in a row, such as "Herr Dr. ".
_TITLES = rf"(?:{_TITLE}\.? )+"
_WORD = r"(?=\p{Lu}[\p{L}\p{M}'’-])\p{Lu}[\p{L}\p{M}]*+(?:['’-]++[\p{L}\p{M}]++)*+"
#: "Smith", "J.", "J.-P.", "J.Smith", or the "J" of "J Smith".
_NAME = rf"(?:(?:\p{{Lu}}\.-?)++(?:{_WORD})?+|{_WORD}|\p{{Lu}}(?= \p{{Lu}}[\p{{L}}\p{{M}}'’.-])){_NO_WORD}"

#: What is looked for, in the order of preference at one place of a text.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)*\.\p{L}{2,}+",
    "iban": _AFTER_NO_WORD + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?" + _NO_WORD,
    "ip": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\p{N}]|\.\d)",
    "ssn": r"(?<![\p{L}\p{N}-])(?:\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4})(?![\p{L}\p{N}-])",
    "card": r"(?<![\p{L}\p{N}])(?:\d{13,19}|\d{4}(?:[ .-]\d{4}){2}[ .-]\d{1,7}|\d{4}[ .-]\d{6}[ .-]\d{5})" + _NO_WORD,
    "phone": rf"(?:\+\d{{1,3}}|{_AFTER_NO_WORD}00[1-9]\d{{0,2}}(?=[ .()-])){_GAP}(?:\(0\) ?)?\d{{2,4}}{_GAP}\d{{2,4}}(?:{_GAP}\d{{2,4}}){{0,3}}{_NO_WORD}"
             rf"|(?<![\p{{L}}\p{{N}}])\(?\d{{3}}\)?[ .-]\d{{3}}[ .-]\d{{4}}{_NO_WORD}",
    "secret": _AFTER_NO_WORD + r"(?=[A-Fa-f]*+\d)[0-9A-Fa-f]{32,}+" + _NO_WORD,
    "name": _AFTER_NO_WORD + rf"{_TITLES}{_NAME}(?: {_NAME})*+",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: The titles that a name starts with, up to its first word.
_HEAD = rf"^({_TITLES})(?=\p{{Lu}})"
#: Every match holds one of these, which are found faster.
_HINT = rf"[0-9@]|{_TITLE}\.? \p{{Lu}}"

#: Attempts at a surrogate of the same format before it may be longer.
FORMAT_ATTEMPTS = 8

_LATIN, _CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщэюя"
_GREEK = "αβγδεζηθικλμνξοπρτυφχψω"
#: Consonants, vowels, and endings for men, women and family names, by script.
_SOUNDS = {
    "latin": ("bdfgklmnprstv", "aeiou", ("ro", "ten", "us"), ("ra", "lia", "nna"), ("ler", "son", "ley")),
    "cyrillic": ("бвгдклмнпрст", "аеиоу", ("ан", "ил", "ор"), ("на", "ия", "ла"), ("ов", "ин", "ский")),
    "greek": ("βγδκλμνπρτ", "αεηιο", ("ος", "ης", "ων"), ("να", "ια", "ρα"), ("ου", "ιδης", "ακης")),
}


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _kind(surface: Column) -> Column:
    # A name may end at what follows it in the text, so it is what nothing else is.
    *others, last = PATTERNS
    kind = F.lit(last)
    for name in reversed(others):
        kind = F.when(surface.rlike(rf"^(?:{PATTERNS[name]})$"), F.lit(name)).otherwise(kind)
    return kind


def _script(word: Column) -> Column:
    return (F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek")
            .otherwise("latin"))


def _words(surface: Column) -> Column:
    """The words of a name after its titles, in small letters and without dots."""
    rest = F.lower(F.regexp_replace(surface, _HEAD, ""))
    # The initials of "J.Smith" and "J.-P. Smith" are words as in "J. Smith" and "J. P. Smith".
    return F.split(F.regexp_replace(F.regexp_replace(rest, r"\.-?(?=\p{L})", " "), r"\.", ""), " ")


def _gender(surface: Column) -> Column:
    titles = F.regexp_extract(surface, _HEAD, 1)
    return (F.when(titles.rlike(rf"\b(?:{FEMALE})\b"), "f").when(titles.rlike(rf"\b(?:{MALE})\b"), "m")
            .otherwise("u"))


def _parts(kind: Column, surface: Column, words: Column) -> Column:
    """What a surface refers to: (kind, canon) of it, or of each of the ``words`` of a name.

    Forms of one thing have one canon: case, spaces and punctuation do not matter.
    A name's last word after the titles is a family name, all before it are given names.
    Initials are given names of their own.
    """
    given = F.transform(words, lambda word, i: F.struct(
        F.concat_ws(".", F.when(i < F.size(words) - 1, "given").otherwise("family"),
                    _script(word)).alias("kind"), word.alias("canon")))
    plain = F.lower(F.regexp_replace(surface, r"[^\p{L}\p{N}+]", ""))
    canon = F.when(kind.isin("email", "ip"), F.lower(surface)).otherwise(plain)
    return F.when(kind == "name", given).otherwise(
        F.array(F.struct(kind.alias("kind"), canon.alias("canon"))))


def _with_gender(parts: DataFrame) -> DataFrame:
    """The gender of the titles before a given name as part of its kind: f, m, or u for none or both.

    One for all mentions of the name, so that "Dr. Anna" and "Mrs. Anna" stay one entity.
    """
    given = parts.filter(F.startswith("kind", F.lit("given."))).groupBy("kind", "canon").agg(
        F.max(F.col("gender") == "f").alias("f"), F.max(F.col("gender") == "m").alias("m"))
    one = F.when(F.col("f") == F.col("m"), "u").when(F.col("f"), "f").otherwise("m")
    known = given.select("kind", "canon", F.regexp_replace("kind", "^given", F.concat(F.lit("given."), one)).alias("_kind"))
    return parts.join(known, ["kind", "canon"], "left").select(
        "surface_id", "at", F.coalesce("_kind", "kind").alias("kind"), "canon")


def _surrogate(kind: str, canon: str, attempt: str, key: str, seed: str) -> str:
    """SQL for the surrogate of a canon: a function of the key, the canon and the attempt alone.

    Later attempts choose from more: mailboxes and names grow by a letter or a syllable
    with each, numbers by a digit with each after the first FORMAT_ATTEMPTS, when their
    format has hardly any free ones left; network addresses then are of version 6.
    ``seed`` is the canon, or a digest of a long one, since it is hashed again and again.
    """
    def number(seed: str, i: str) -> str:
        # Four hexadecimal digits for each place, 32 places from each hash.
        block = f"sha2(concat_ws('|', {_lit(key)}, {seed}, cast(({i}) DIV 32 AS string)), 512)"
        return f"cast(conv(substr({block}, 4 * (({i}) % 32) + 1, 4), 16, 10) AS int)"

    def pick(alphabet: str, n: str) -> str:
        return f"substr({_lit(alphabet)}, {n} % {len(alphabet)} + 1, 1)"

    def mapped(text: str, seed: str) -> str:
        n = number(seed, "i")
        return (f"array_join(transform(regexp_extract_all({text}, '(?s).', 0), (c, i) -> CASE "
                f"WHEN c BETWEEN '0' AND '9' THEN {pick('0123456789', n)} "
                f"WHEN c RLIKE '\\\\p{{IsCyrillic}}' THEN {pick(_CYRILLIC, n)} "
                f"WHEN c RLIKE '\\\\p{{IsGreek}}' THEN {pick(_GREEK, n)} "
                f"WHEN c RLIKE '\\\\p{{L}}' THEN {pick(_LATIN, n)} ELSE c END), '')")

    def more(after: int, piece) -> str:
        """A piece for each attempt beyond the first ones."""
        return (f"CASE WHEN {attempt} > {after} THEN array_join(transform(sequence(1, {attempt} - {after}), "
                f"j -> {piece}), '') ELSE '' END")

    seed = f"{kind}, {seed}, cast({attempt} AS string)"
    crowded = f"{attempt} > {FORMAT_ATTEMPTS}"
    further = more(FORMAT_ATTEMPTS, pick("0123456789", number(seed, "900 + j")))
    local, domain = f"substring_index({canon}, '@', 1)", f"substring_index({canon}, '@', -1)"
    below = f"regexp_replace({domain}, '\\\\.[^.]*$', '')"
    email = f"concat({mapped(local, seed)}, {more(0, pick(_LATIN, number(seed, '900 + j')))}, '@', {mapped(below, _lit('domain') + ', ' + domain)}, '.example')"
    octets = [f"cast({number(seed, '0')} % 223 + 1 AS string)",
              *[f"cast({number(seed, str(i))} % 256 AS string)" for i in (1, 2, 3)]]
    groups = [f"lower(hex({number(seed, str(i))}))" for i in range(4, 10)]
    ip = f"CASE WHEN {crowded} THEN concat('2001:db8:', concat_ws(':', {', '.join(groups)})) ELSE concat_ws('.', {', '.join(octets)}) END"
    secret = (f"array_join(transform(sequence(0, length({canon}) - 1), i -> "
              f"{pick('0123456789abcdef', number(seed, 'i'))}), '')")
    digits = mapped(canon, seed)

    def luhn(text: str) -> str:
        """The sum that a valid card number has a multiple of ten of."""
        double = "2 * try_cast(c AS bigint)"
        return (f"aggregate(transform(split(reverse({text}), ''), (c, i) -> CASE WHEN i % 2 = 0 "
                f"THEN try_cast(c AS bigint) ELSE {double} DIV 10 + {double} % 10 END), "
                "cast(0 AS bigint), (s, x) -> s + coalesce(x, 0))")
    stem = f"substr({digits}, 1, length({canon}) - 1)"
    card = (f"CASE WHEN {luhn(canon)} % 10 = 0 THEN concat({stem}, "
            f"cast((10 - {luhn(f'concat({stem}, 0)')} % 10) % 10 AS string)) ELSE {digits} END")
    phone = (f"CASE WHEN {canon} LIKE '+%' THEN concat(substr({canon}, 1, 2), substr({digits}, 3)) "
             f"ELSE {digits} END")
    iban = f"concat(substr({canon}, 1, 2), substr({digits}, 3))"

    def named(script: str, ending: int) -> str:
        consonants, vowels, *endings = _SOUNDS[script]
        sounds = [pick(consonants if i % 2 == 0 else vowels, number(seed, str(i))) for i in range(6)]
        options = ", ".join(_lit(e) for e in endings[ending])
        longer = more(0, f"concat({pick(consonants, number(seed, '900 + 2 * j'))}, {pick(vowels, number(seed, '901 + 2 * j'))})")
        return f"concat({', '.join(sounds)}, {longer}, element_at(array({options}), {number(seed, '6')} % 3 + 1))"

    names = " ".join(
        f"WHEN {kind} = '{role}.{script}' THEN {named(script, ending)}"
        for script in _SOUNDS
        for role, ending in (("given.m", 0), ("given.f", 1), ("given.u", 2), ("family", 2)))
    return (f"CASE {kind} WHEN 'email' THEN {email} WHEN 'ip' THEN {ip} WHEN 'secret' THEN {secret} "
            f"WHEN 'card' THEN concat({card}, {further}) WHEN 'phone' THEN concat({phone}, {further}) "
            f"WHEN 'iban' THEN concat({iban}, {further}) ELSE CASE {names} ELSE concat({digits}, {further}) END END")


def assign_surrogates(entities: DataFrame, key: str, max_rounds: int = 50) -> DataFrame:
    """Each distinct (``kind``, ``canon``) with a ``surrogate`` of its own.

    A candidate is taken if it is no entity of the same kind itself, is not taken yet,
    and no smaller canon wants it; the others try again with the next hash. So distinct
    entities keep distinct surrogates, and none is an entity of the corpus. Rounds go on
    until all have one; as later attempts choose from ever more, that takes few rounds
    however many entities there are.
    """
    seed = F.when(F.length("canon") > 128, F.sha2("canon", 256)).otherwise(F.col("canon")).alias("seed")
    originals = durable_table(entities.select("kind", "canon").distinct().select("kind", "canon", seed))
    pending = originals.withColumn("attempt", F.lit(0))
    taken = None
    known = originals.select("kind", F.col("canon").alias("surrogate"))
    for _ in range(max_rounds):
        wanted = durable_table(pending.withColumn(
            "surrogate", F.expr(_surrogate("kind", "canon", "attempt", key, "seed"))))
        first = wanted.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon"))
        free = first.join(known, ["kind", "surrogate"], "left_anti")
        if taken is not None:
            free = free.join(taken, ["kind", "surrogate"], "left_anti")
        free = durable_table(free.select("kind", "canon", "surrogate"))
        taken = free if taken is None else taken.union(free)
        pending = wanted.join(free, ["kind", "canon"], "left_anti").select(
            "kind", "canon", "seed", (F.col("attempt") + 1).alias("attempt"))
        pending = durable_table(pending)
        if pending.isEmpty():
            return taken
    raise RuntimeError(f"{pending.count()} entities have no surrogate after {max_rounds} rounds")


def _render(kind: str, surface: str, found: str) -> str:
    """SQL for a surrogate in the surface's format and case; ``found`` lists the parts' surrogates."""
    one = f"{found}[0]"
    cased = f"CASE WHEN {surface} = upper({surface}) THEN upper({one}) ELSE {one} END"
    # Letters and digits are filled in one after the other; all else stays.
    filled = (f"aggregate(regexp_extract_all({surface}, '(?s).', 0), named_struct('out', '', 'at', 1), "
              f"(s, c) -> CASE WHEN c RLIKE '[\\\\p{{L}}\\\\p{{N}}+]' THEN named_struct('out', concat(s.out, "
              f"CASE WHEN c = lower(c) THEN substr({one}, s.at, 1) ELSE upper(substr({one}, s.at, 1)) END), "
              "'at', s.at + 1) ELSE named_struct('out', concat(s.out, c), 'at', s.at) END, "
              f"s -> concat(s.out, substr({one}, s.at)))")
    name = (f"concat(regexp_extract({surface}, {_lit(_HEAD)}, 1), "
            f"array_join(transform({found}, w -> initcap(w)), ' '))")
    return (f"CASE WHEN {kind} = 'name' THEN {name} WHEN {kind} IN ('email', 'ip', 'secret') THEN {cased} "
            f"ELSE {filled} END")


def replace_entities(docs: DataFrame, key: str, text: str = "text",
                     count: str | None = "n_entities") -> DataFrame:
    """``docs`` with every detected entity of its texts replaced by a surrogate.

    An entity gets the same surrogate wherever it stands (also in another format or
    case, and a family name with or without given names), distinct ones get distinct
    surrogates, and no surrogate is an entity of ``docs``. Surrogates keep the type, the
    script, a title's gender, and the format: punctuation, length of numbers, case, a
    valid check digit of cards; mail domains end in ``.example``. Who has ``key`` can
    make them again. Initials get whole given names, as letters would not stay distinct. ``count`` (long) replaces a column of that name.

    The rows are written once with what was found in them. Only texts with an entity take part in joins, by a digest, equal texts once. NULL
    and empty texts, and texts without an entity, stay as they are. Everything is
    linear in a text. An entity that stands in most texts is joined like any other;
    such a join can be split.
    """
    columns = [c for c in docs.columns if c != count]
    body = F.col(f"`{text}`").cast("string")
    hits = F.when(body.rlike(_HINT), F.regexp_extract_all(body, F.lit(PATTERN), F.lit(0)))
    # The only time that the patterns go over all texts.
    read = durable_table(docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), hits.alias("_hits")))
    has = F.coalesce(F.size("_hits"), F.lit(0)) > 0
    body = F.col("_row").getField(text).cast("string")
    found = (read.filter(has).select(F.md5(body).alias("text_id"), F.array_distinct("_hits").alias("surfaces"))
             .dropDuplicates(["text_id"]))
    mentions = durable_table(found.select("text_id", F.explode("surfaces").alias("surface")))
    surfaces = mentions.select("surface").distinct().withColumn("kind", _kind(F.col("surface")))
    # Written first, or the words would be split again for each of them.
    surfaces = durable_table(surfaces.withColumns({
        "surface_id": F.md5("surface"),
        "words": F.when(F.col("kind") == "name", _words(F.col("surface"))),
        "gender": _gender(F.col("surface"))}))
    parts = durable_table(surfaces.select(
        "surface_id", "gender",
        F.posexplode(_parts(*map(F.col, ("kind", "surface", "words")))).alias("at", "part"))
        .select("surface_id", "gender", "at", "part.*"))
    parts = durable_table(_with_gender(parts))
    assigned = assign_surrogates(parts, key)
    replacements = (
        parts.join(assigned, ["kind", "canon"]).groupBy("surface_id")
        .agg(F.sort_array(F.collect_list(F.struct("at", "surrogate"))).alias("found"))
        .join(surfaces.select("surface_id", "surface", "kind"), "surface_id")
        .select("surface", F.expr(_render("kind", "surface", "found.surrogate")).alias("replacement")))
    # A map holds the entities of one text only.
    maps = (mentions.join(replacements, "surface").groupBy("text_id")
            .agg(F.map_from_entries(F.collect_list(F.struct("surface", "replacement"))).alias("_map")))
    gaps = F.split(body, PATTERN, -1)
    rebuilt = F.concat(F.col("_gaps")[0], F.array_join(F.transform(
        "_hits", lambda hit, i: F.concat(F.element_at("_map", hit), F.get("_gaps", i + 1))), ""))
    marked = read.filter(has).select(
        "_row", F.md5(body).alias("text_id"), gaps.alias("_gaps"), "_hits").join(maps, "text_id")
    changed = marked.select(
        *[rebuilt.alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in columns],
        *([F.size("_hits").cast("long").alias(count)] if count else []))
    same = read.filter(~has).select("_row.*", *([F.lit(0).cast("long").alias(count)] if count else []))
    return same.union(changed)
