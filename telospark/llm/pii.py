"""Surrogates for personal data; DataFrame functions only.

Each detected entity is replaced by a value derived from a secret key and the entity's canonical
form, so the same entity gets the same surrogate everywhere (coreference), written in each
mention's own format: separators, letter case, script, digit groups, country codes, top-level
domains, private network ranges, card checksums, and the gender and script of names are kept. The
distinct entities of the corpus are then checked: two entities of a kind whose surrogates agree, or
a surrogate that is itself an entity of the corpus, are given another attempt until all differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telospark.llm.common import small_enough, table

_TITLES_M = "Mr|Sir|Herr|Monsieur|Señor|Г-н"
_TITLES_F = "Mrs|Ms|Miss|Frau|Madame|Mademoiselle|Señora|Señorita|Г-жа"
#: A masculine title as a whole: "Mrs" doesn't begin with "Mr", nor "Señora" with "Señor".
_MAN = rf"^(?:{_TITLES_M})(?![\p{{L}}\-])"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: What stands before the IPv4 address in one that is mapped to IPv6.
_MAPPED = "(?<![0-9A-Fa-f:.])(?:::|(?:0{1,4}:){5})[Ff]{4}:"

#: kind: pattern, in order of precedence.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)*\.\p{L}{2,}+",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-fA-F]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})(?![A-Za-z0-9])|(?<=[=:\"' ])(?<=(?i:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s{0,2}[=:]\s{0,2}[\"']?)(?=[A-Za-z0-9+/_\-]*[0-9])[A-Za-z0-9+/_\-]{8,128}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?:(?<![0-9.])|{_MAPPED})(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "ip6": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
    # with "::": a digit and a group of three or more must be there, so that slices and scopes in code stay
    r"|(?<![\p{L}0-9:.])(?=[A-Fa-f:]*[0-9])(?=(?:[0-9A-Fa-f]{0,2}:)*[0-9A-Fa-f]{3})(?!(?:[0-9A-Fa-f]*:){9})(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?(?![\p{L}0-9:]|\.[0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "card": r"(?<![0-9\-])(?:[0-9]{4}[ \-]){3}[0-9]{1,7}(?![0-9])|(?<![0-9\-])[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{4,5}(?![0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])",
    "phone": r"(?<![0-9\p{L}])(?:\+[0-9]{1,3}[ .\-]?\([0-9]{1,4}\)[ .\-]?[0-9]{2,4}[ .\-]?[0-9]{3,4}|\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}|[0-9]{3}[.\- ][0-9]{3}[.\- ][0-9]{4}|\(0[0-9]{1,5}\) ?[0-9]{3,8}(?:[ \-][0-9]{2,5}){0,2}|0[0-9]{2,4}[ /\-][0-9]{5,8}|0[0-9]{2,4}[ \-][0-9]{3,4}[ \-][0-9]{3,4}|0[1-9](?:[ .\-][0-9]{2}){4}|\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,5})(?![0-9])",
    "name": rf"(?<!\p{{L}})(?:{_TITLES_M}|{_TITLES_F})\.? \p{{Lu}}[\p{{L}}'’\-]++(?: \p{{Lu}}[\p{{L}}'’\-]++){{0,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without these has no entity; most texts stop here.
HINT = rf"[0-9@]|AKIA|sk-|gh[pousr]_|(?:{_TITLES_M}|{_TITLES_F})"

_LATIN, _CYRILLIC, _GREEK = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω"
_FIRST = {
    ("m", "latin"): "Adam Bruno Carlos David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Nils Oscar Paul Robert Simon Thomas Victor".split(),
    ("f", "latin"): "Alice Berta Clara Diana Emma Flora Greta Helen Irene Julia Karen Laura Maria Nora Olivia Paula Rosa Sofia Teresa Vera".split(),
    ("m", "cyrillic"): "Алексей Борис Виктор Григорий Денис Егор Игорь Кирилл Леонид Максим Николай Олег Павел Роман Сергей Юрий".split(),
    ("f", "cyrillic"): "Алла Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лариса Мария Нина Ольга Полина Раиса Юлия".split(),
    ("m", "greek"): "Άγγελος Γιάννης Δημήτρης Ηλίας Θωμάς Κώστας Μάρκος Νίκος Πέτρος Σπύρος".split(),
    ("f", "greek"): "Άννα Βάσω Γεωργία Δήμητρα Ελένη Ζωή Κατερίνα Μαρία Νίκη Σοφία".split(),
}
_SYLLABLES = {"latin": "ba be bo da de do fa fi go ha ka ko la le li lo ma me mi mo na ne no pa pe ra re ro sa se si so ta te ti to va ve vi vo".split(), "cyrillic": "ба бе бо ва ве го да де до за ка ко ла ле ло ма ме ми мо на не но па пе ра ре ро са се со та те то фа ха".split(), "greek": "βα βε γα δα δε ζα θα κα κο λα λε λο μα με μο να νε νο πα πε ρα ρε ρο σα σε τα τε το φα".split()}


def _has(c: Column, pattern: str) -> Column:
    return F.rlike(c, F.lit(pattern))


def _sub(c: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, pattern, to)


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _pick(items: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), (number % len(items) + 1).cast("int"))


def kind_of(mention: Column) -> Column:
    """The kind of a mention by itself; what fits no other pattern is a secret, some of which only
    the words before them tell."""
    out = F.lit("secret")
    for kind, p in reversed(PATTERNS.items()):
        out = F.when(_has(mention, f"^(?:{p})$"), F.lit(kind)).otherwise(out) if kind != "secret" else out
    return out


def _groups(m: Column) -> tuple[Column, Column, Column]:
    """Groups of an IPv6 address before and after "::", and all eight."""
    part = lambda c: F.filter(F.split(c, ":"), lambda g: g != "")
    left = part(F.substring_index(m, "::", 1))
    right = F.when(F.contains(m, F.lit("::")), part(F.substring_index(m, "::", -1))).otherwise(F.array().cast("array<string>"))
    return left, right, F.concat(left, F.array_repeat(F.lit("0"), 8 - F.size(left) - F.size(right)), right)


def _ip6(m: Column, s: Column) -> Column:
    """Digits of each group replaced by its place in the whole address, so that all spellings of an
    address get the same one; zero groups and leading zeros stay."""
    left, right, _ = _groups(m)
    low = _has(m, "[a-f]") | ~_has(m, "[A-F]")

    def group(g: Column, at: Column) -> Column:
        body = _sub(g, "^0+")
        n = F.length(body)
        new = F.concat(_pick(list("123456789abcdef"), _number(s, at * 16)), F.substring(s, at * 16 + 7, n - 1))
        return F.concat(F.substring(g, F.lit(1), F.length(g) - n), F.when(n == 0, F.lit("")).otherwise(F.when(low, new).otherwise(F.upper(new))))

    before = F.array_join(F.transform(left, group), ":")
    after = F.array_join(F.transform(right, lambda g, i: group(g, 8 - F.size(right) + i)), ":")
    return F.when(F.contains(m, F.lit("::")), F.concat(before, F.lit("::"), after)).otherwise(before)


def canonical(kind: Column, m: Column) -> Column:
    """One form for all spellings of an entity: case, separators and titles don't count."""
    bare = F.lower(_sub(m, r"[^\p{L}\p{N}]"))
    phone = F.when(m.startswith("+"), F.concat(F.lit("+"), _sub(F.regexp_extract(m, r"^\+([0-9]{1,3})(?![0-9])", 1), r"[^0-9]"), F.lit(" "), _sub(_sub(m, r"^\+[0-9]{1,3}(?![0-9])"), r"[^0-9]"))).otherwise(bare)
    gender = F.when(_has(m, _MAN), F.lit("m ")).otherwise(F.lit("f "))
    name = F.concat(gender, F.lower(_sub(m, r"^[\p{L}\-]+\.? ")))
    return F.when(kind == "phone", phone).when(kind == "name", name).when(kind == "ip", _sub(m, "^.*:")).when(kind == "ip6", F.concat_ws(":", F.transform(_groups(m)[2], lambda g: _sub(F.lower(g), "^0+")))).when(kind == "email", F.lower(m)).otherwise(bare)


def _stream(key: str, kind: Column | str, value: Column, attempt: Column) -> Column:
    """128 hex digits that depend on all of these and can't be foretold without the key."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    inner = F.sha2(F.encode(F.concat_ws("\x1f", F.lit(key), kind, value, attempt.cast("string")), "UTF-8"), 512)
    return F.sha2(F.encode(F.concat(F.lit(key), inner), "UTF-8"), 512)


def _number(stream: Column, at: int | Column, digits: int = 6) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substring(stream, at + 1, F.lit(digits)), 16, 10).cast("long")


def _substitute(m: Column, stream: Column, keep: Column, hexadecimal: Column) -> Column:
    """Each letter or digit of m after the first `keep` of them, replaced by one of its class, case
    and script; all else stays."""

    def with_stream(s: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            at = F.length(_sub(F.substring(m, F.lit(1), i), r"[^\p{L}\p{N}]"))
            v = _number(s, (at * 2) % 120, 6)
            letter = F.when(_has(c, r"\p{IsCyrillic}"), _pick(list(_CYRILLIC), v)).when(_has(c, r"\p{IsGreek}"), _pick(list(_GREEK), v)).otherwise(_pick(list(_LATIN), v))
            new = F.when(hexadecimal, _pick(list("0123456789abcdef"), v)).when(_has(c, r"\p{N}"), (v % 10).cast("string")).otherwise(letter)
            cased = F.when(hexadecimal & _has(m, "[A-F]") & ~_has(m, "[a-f]"), F.upper(new)).when(~hexadecimal & _has(c, r"\p{Lu}"), F.upper(new)).otherwise(new)
            return F.when(~_has(c, r"[\p{L}\p{N}]") | (at < keep), c).otherwise(cased)

        return F.array_join(F.transform(F.regexp_extract_all(m, F.lit(r"(?s)."), F.lit(0)), one), "")

    return _let(stream, with_stream)


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""

    def one(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    parts = F.transform(F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0)), one)
    return F.aggregate(parts, F.lit(0), lambda a, b: a + b) % 10


def _checked(m: Column, x: Column) -> Column:
    """The number x, with a check digit where m has a right one."""
    body = F.substring(x, F.lit(1), F.length(x) - 1)
    check = (10 - _luhn(F.concat(_sub(body, "[^0-9]"), F.lit("0")))) % 10
    return F.when(_luhn(_sub(m, "[^0-9]")) == 0, F.concat(body, check.cast("string"))).otherwise(x)


def _name(key: str, m: Column, attempt: Column) -> Column:
    """Title kept; first name from a list of the same gender and script; each surname keyed on
    itself alone, so that short and full forms agree. Hyphens, apostrophes and the number of names stay. Later
    attempts add an initial."""
    title, rest = F.regexp_extract(m, r"^[\p{L}\-]+\.? ", 0), _sub(m, r"^[\p{L}\-]+\.? ")
    man = _has(title, _MAN)
    script = F.when(_has(rest, r"\p{IsCyrillic}"), F.lit("cyrillic")).when(_has(rest, r"\p{IsGreek}"), F.lit("greek")).otherwise(F.lit("latin"))
    sex = F.when(man, F.lit("m")).otherwise(F.lit("f"))
    f = _stream(key, "name", F.concat_ws(" ", sex, F.lower(rest)), attempt)
    alphabet = {"latin": _LATIN, "cyrillic": _CYRILLIC, "greek": _GREEK}

    def by_script(of) -> Column:
        return F.when(script == "cyrillic", of("cyrillic")).when(script == "greek", of("greek")).otherwise(of("latin"))

    def letter(v: Column) -> Column:
        return by_script(lambda of: F.upper(_pick(list(alphabet[of]), v)))

    def parts_of(word: Column, part) -> Column:
        """word with part(letters, place) for each run of letters; what stands between them stays."""
        runs = F.regexp_extract_all(word, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
        return F.array_join(F.transform(runs, lambda x, i: F.when(_has(x, r"^\p{L}"), part(x, i)).otherwise(x)), "")

    def surname(word: Column) -> Column:
        def part(x: Column, i: Column) -> Column:
            return _let(_stream(key, "surname", F.lower(x), F.lit(0)), lambda s: F.when(F.length(x) == 1, letter(_number(s, 0))).otherwise(
                by_script(lambda of: F.initcap(F.concat(*(_pick(_SYLLABLES[of], _number(s, k)) for k in (0, 8, 16, 24)))))
            ))

        return parts_of(word, part)

    def given(word: Column) -> Column:
        def part(x: Column, i: Column) -> Column:
            v = _number(f, 8 * (i % 8))
            return F.when(F.length(x) == 1, letter(v)).otherwise(by_script(lambda of: F.when(man, _pick(_FIRST["m", of], v)).otherwise(_pick(_FIRST["f", of], v))))

        return parts_of(word, part)

    words = F.split(rest, " ")
    extra = F.when(attempt > 0, F.concat(letter(_number(f, 72)), F.lit(". "))).otherwise(F.lit(""))
    last = F.array_join(F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), surname), " ")
    full = F.when(F.size(words) > 1, F.concat(given(words[0]), F.lit(" "), extra, last)).otherwise(F.concat(extra, surname(words[0])))
    return F.concat(title, F.when(F.upper(rest) == rest, F.upper(full)).otherwise(full))


def surrogate(kind: Column, m: Column, attempt: Column, key: str) -> Column:
    """The replacement of one mention. The higher-order functions keep this out of generated code:
    mentions are few and the expression is long."""

    def of(m: Column, kind: Column, s: Column) -> Column:
        no, none = F.lit(False), F.lit(0)
        fixed = F.regexp_extract(_sub(m, "^.*:"), r"^(?:10\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|127\.)", 0)
        octet = [(_number(s, 6 * k) % (256 if k < 3 else 254) + (0 if k < 3 else 1)).cast("string") for k in range(4)]
        ip = F.when(fixed == "", F.concat_ws(".", (_number(s, 0) % 100 + 11).cast("string"), *octet[1:])).when(_has(fixed, r"^1(?:0|27)\.$"), F.concat(fixed, F.concat_ws(".", *octet[1:]))).otherwise(F.concat(fixed, F.concat_ws(".", *octet[2:])))
        # How many letters and digits stay: country codes, issuers, key prefixes.
        keep = (
            F.when(kind == "phone", F.when(_has(m, r"^\(?0"), 1).otherwise(F.length(F.regexp_extract(m, r"^\+([0-9]{1,3})(?![0-9])", 1))))
            .when(kind == "secret", F.length(_sub(F.regexp_extract(m, "^(?:AKIA|gh[pousr]_|sk-)", 0), "[^A-Za-z0-9]")))
            .when(kind == "iban", F.lit(2))
            .when(kind == "card", F.lit(1))
            .otherwise(none)
        )
        digits = (kind == "secret") & _has(m, "^[0-9a-fA-F]+$")
        domain = F.substring_index(m, "@", -1)
        tld = F.substring_index(domain, ".", -1)
        host = F.substring(domain, F.lit(1), F.length(domain) - F.length(tld) - 1)
        new_host = _let(host, lambda h: _substitute(h, _stream(key, "host", F.lower(h), none), none, no))
        body = F.when(kind == "email", F.substring_index(m, "@", 1)).otherwise(m)
        plain = _let(body, lambda x: _substitute(x, s, keep, digits))
        return (
            F.when(kind == "ip", F.concat(F.regexp_extract(m, "^.*:", 0), ip))
            .when(kind == "ip6", _ip6(m, s))
            .when(kind == "name", _name(key, m, attempt))
            .when(kind == "email", F.concat(plain, F.lit("@"), new_host, F.lit("."), tld))
            .when(kind == "card", _let(plain, lambda x: _checked(m, x)))
            .otherwise(plain)
        )

    return _let(F.struct(m.alias("m"), kind.alias("kind")), lambda x: _let(_stream(key, x["kind"], canonical(x["kind"], x["m"]), attempt), lambda s: of(x["m"], x["kind"], s)))


def mentions(text: Column) -> Column:
    return F.when(_has(text, HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def named(mention: Column) -> Column:
    """struct(kind, c): kind and canonical form of a mention."""
    return _let(mention, lambda m: _let(kind_of(m), lambda k: F.struct(k.alias("kind"), canonical(k, m).alias("c"))))


def entity_attempts(df: DataFrame, key: str, text: str = "text", rounds: int = 40) -> DataFrame:
    """(entity, attempt) of the entities whose first surrogate may not stand, entity being
    'kind|canonical'. As a rule there are none."""
    found = df.select(F.explode(F.array_distinct(mentions(F.col(text)))).alias("m")).groupBy("m").agg(F.count("*").alias("n"))
    found = found.select("m", named(F.col("m")).alias("e")).groupBy("e.kind", "e.c").agg(F.min("m").alias("m"))
    found = table(found, "entities").withColumn("attempt", F.lit(0))
    taken = None
    pending, settled = found, None
    for attempt in range(rounds):
        new = pending.withColumn("attempt", F.lit(attempt)).withColumn("s", _let(surrogate(F.col("kind"), F.col("m"), F.lit(attempt), key), lambda s: canonical(F.col("kind"), s)))
        new = table(new, "surrogates")
        # One entity may have a surrogate (the smallest), unless it is an entity or is taken.
        first = new.groupBy("kind", "s").agg(F.min("c").alias("c"))
        good = first.join(found.selectExpr("kind", "c as s"), ["kind", "s"], "left_anti")
        good = good if taken is None else good.join(taken, ["kind", "s"], "left_anti")
        good = table(good, "good")
        pending = new.join(good.select("kind", "c"), ["kind", "c"], "left_anti").drop("s")
        taken = good.select("kind", "s") if taken is None else taken.union(good.select("kind", "s"))
        if attempt:
            rows = new.join(good.select("kind", "c"), ["kind", "c"], "left_semi").select(F.concat_ws("|", "kind", "c").alias("entity"), "attempt")
            settled = rows if settled is None else settled.union(rows)
        pending = table(pending, "pending")
        if pending.isEmpty():
            break
    else:
        raise RuntimeError(f"surrogates still collide after {rounds} attempts")
    return settled if settled is not None else found.select(F.concat_ws("|", "kind", "c").alias("entity"), "attempt").limit(0)


def pseudonymize(df: DataFrame, key: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """df with its text rewritten and n_entities (mentions replaced).

    Kinds: PATTERNS; names only after a title. Texts without an entity, null and empty texts stay
    as they are (n_entities 0). The key is a secret of the caller; the same key gives the same
    surrogates in every run. Repeated rows are rewritten alike; rows with a null id too. Extra
    columns pass through; n_entities replaces a column of that name. An empty table stays empty.
    """
    exceptions = entity_attempts(df, key, text)
    body = F.col(text)
    df = df.withColumn("__telo_m", mentions(body))
    if exceptions.isEmpty():
        df = df.withColumn("__telo_x", F.lit(None).cast("map<string,int>"))
    else:
        exceptions = small_enough(table(exceptions, "exceptions"))
        hit = df.where(F.size("__telo_m") > 0).select(F.xxhash64("__telo_m").alias("__telo_h"), "__telo_m").dropDuplicates(["__telo_h"]).select("__telo_h", F.explode(F.array_distinct("__telo_m")).alias("m"))
        hit = hit.withColumn("entity", _let(named(F.col("m")), lambda e: F.concat_ws("|", e["kind"], e["c"])))
        hit = hit.join(exceptions, "entity").select("__telo_h", "entity", "attempt").distinct()
        hit = hit.groupBy("__telo_h").agg(F.map_from_entries(F.collect_list(F.struct("entity", "attempt"))).alias("__telo_x"))
        df = df.withColumn("__telo_h", F.when(F.size("__telo_m") > 0, F.xxhash64("__telo_m"))).join(small_enough(table(hit, "hits")), "__telo_h", "left").drop("__telo_h")

    def one(m: Column) -> Column:
        attempt = lambda e: F.coalesce(F.try_element_at(F.col("__telo_x"), F.concat_ws("|", e["kind"], e["c"])), F.lit(0))
        return _let(named(m), lambda e: _let(attempt(e), lambda n: surrogate(e["kind"], m, n, key)))

    new = F.concat(F.array_join(F.zip_with(F.slice(F.split(body, ANY, -1), F.lit(1), F.size("__telo_m")), F.transform("__telo_m", one), lambda a, b: F.concat(a, b)), ""), F.element_at(F.split(body, ANY, -1), -1))
    return df.withColumn("n_entities", F.size("__telo_m").cast("long")).withColumn(text, F.when(F.size("__telo_m") > 0, new).otherwise(body)).drop("__telo_m", "__telo_x")
