"""Surrogates for personal data, in DataFrame functions only.

Detected entities are e-mail and IP addresses, payment cards, other long numbers, account numbers (IBAN), social security and
phone numbers, and names: behind a title, or a common given name and a capitalised word. A mention is cut into parts that have an
identity of their own: a name into given and family names, an address into what is before the @ and the labels of its domain.
A part's canonical form (digits of a number, lower case of a name) and a key give its surrogate: the same type, script and
gender, valid check digits, and the format of each mention. So all mentions of a person change alike, with or without a title or a given
name, and so do all addresses of a domain. In a text that names somebody the bare words of the name change, too. Surrogates are made for
the table of different parts; those that equal another surrogate or a real entity are drawn again until all are different.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskframe.llm.common import Work

# Patterns of entities, in the order in which they are tried.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.){1,126}[A-Za-z]{2,}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IP = r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}(?!\.?\d)"
NUMBER = r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"
MALE = "Mr|Herr|Monsieur|Señor|Signor|Sr|господин|г-н"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Signora|госпожа|г-жа"
TITLES = rf"(?:{MALE}|{FEMALE}|Dr|Prof)\.?"
WORD = r"(?:[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+|[А-ЯЁ][а-яё]+)"
# Common given names by gender and script, and syllables of family names by script.
GIVEN = {
    ("male", "latin"): "Adam Albert Alexander Andreas Anthony Antoine Bruno Carl Carlos Charles Christian Daniel David Diego Edward Emil Felix Francisco Georg Henry Hugo Jacques James Jean John Jonas José Juan Karl Klaus Leon Luis Marc Martin Michael Miguel Nils Oscar Paul Peter Pierre Robert Simon Thomas Victor Walter William".split(),
    ("female", "latin"): "Ada Alice Alma Ana Anna Anne Berta Carmen Catherine Charlotte Clara Claudia Diana Elena Elizabeth Emma Eva Frida Greta Hannah Helena Ida Isabel Jane Julia Karin Klara Laura Lucía Maria Marie Martha Mary Monika Nicole Nora Olivia Paula Petra Rosa Sara Sophie Susan Teresa Tina Ursula Vera Wanda".split(),
    ("male", "cyrillic"): "Александр Алексей Андрей Антон Борис Виктор Глеб Денис Дмитрий Егор Захар Иван Игорь Кирилл Лев Максим Михаил Никита Николай Олег Павел Роман Семён Сергей".split(),
    ("female", "cyrillic"): "Алла Анна Белла Вера Галина Дарья Ева Екатерина Елена Зоя Инна Ирина Кира Лариса Людмила Мария Наталья Нина Ольга Полина Роза Светлана София Татьяна".split(),
}
SYLLABLES = {"latin": "ba be bo da de do fa fe ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va ve vo za".split(), "cyrillic": "ба бе бо ва ве во да де до ка ке ко ла ле ло ма ме мо на не но ра ре ро са се со та те то за зо ши жа".split()}
KNOWN = "|".join(name for names in GIVEN.values() for name in names)
#: Names begin with a capital, or with the г of a title; that is looked for first, which spares trying all names at each place.
HEAD = r"(?<!\p{L})(?=[\p{Lu}г])"
NAME = rf"{HEAD}(?:{TITLES} {WORD}(?:-{WORD})?(?: {WORD}(?:-{WORD})?)?|(?:{KNOWN}) {WORD}(?:-{WORD})?)(?!\p{{L}})"
ENTITY = "|".join((EMAIL, IBAN, IP, NUMBER, SSN, PHONE, NAME))
#: A text without any of these holds no entity.
HINT = rf"[@0-9]|{HEAD}(?:{MALE}|{FEMALE}|Dr|Prof|{KNOWN})\.? "
OCTETS = [n for n in range(11, 224) if n not in (100, 127, 169, 172, 192, 198, 203)]
#: Entities are drawn anew at most so often. After LONGER draws those of free length grow by a character, so that short ones find room.
DRAWS, LONGER = 60, 6
#: Where letters begin or end.
EDGE = r"(?<=\p{L})(?!\p{L})|(?<!\p{L})(?=\p{L})"


def hexes(key: str, *parts: Column) -> Column:
    """128 keyed hexadecimal digits."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 512)


def number(digest: Column, at: int, below: int) -> Column:
    """A number below ``below`` from six digits of a digest."""
    return (F.conv(F.substring(digest, at, 6), 16, 10).cast("long") % below).cast("int")


def pick(values: list, digest: Column, at: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), number(digest, at, len(values)) + 1)


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def kinds(value: Column) -> Column:
    """The type of a whole mention."""
    whole = lambda p: value.rlike(f"^(?:{p})$")
    bare = digits_only(value)
    return (
        F.when(value.contains("@"), "email")
        .when(value.rlike(r"^\p{L}") & ~value.rlike("[0-9]"), "name")
        .when(whole(IBAN), "iban")
        .when(whole(IP), "ip")
        .when(whole(r"\d(?:[ -]?\d){12,18}"), F.when(F.call_function("luhn_check", bare), "card").otherwise("number"))
        .when(whole(SSN), "ssn")
        .otherwise("phone")
    )


def untitled(value: Column) -> Column:
    return F.regexp_replace(value, rf"^{TITLES} ", "")


def parts(kind: Column, value: Column) -> Column:
    """What has an identity in a mention, in order: array<struct<kind, entity, gender, word>>.

    All mentions of an entity share its canonical form. Phone numbers: their last nine digits; names: each word in lower case, by
    script; the last word (and what a hyphen joins to it) is the family name. gender is known of given names only, from a title.
    """
    row = lambda kind, entity, gender=None, word=None: F.struct(kind.alias("kind"), entity.alias("entity"), (gender if gender is not None else F.lit(None).cast("string")).alias("gender"), (word if word is not None else F.lit(None).cast("string")).alias("word"))
    title = F.when(value.rlike(rf"^(?:{MALE})[. ]"), "male").when(value.rlike(rf"^(?:{FEMALE})[. ]"), "female")
    script = F.when(value.rlike("[А-Яа-яЁё]"), "cyrillic").otherwise("latin")
    bare = untitled(value)
    # words before the last space are given names
    given = F.regexp_count(bare, F.lit("[ -]")) - F.regexp_count(F.substring_index(bare, " ", -1), F.lit("-"))
    names = F.transform(F.split(bare, "[ -]"), lambda w, i: row(F.concat(F.when(i < given, "given:").otherwise("family:"), script), F.lower(w), F.when(i < given, title), w))
    domain = F.slice(F.split(F.lower(F.substring_index(value, "@", -1)), r"\."), 1, 127)
    labels = F.transform(F.slice(domain, F.lit(1), F.size(domain) - 1), lambda x: row(F.lit("label"), x))
    plain = (
        F.when(kind == "iban", F.regexp_replace(value, " ", ""))
        .when(kind == "ip", value)
        .when(kind == "phone", F.expr("right(regexp_replace(value, '[^0-9]', ''), 9)"))
        .otherwise(digits_only(value))
    )
    return F.when(kind == "name", names).when(kind == "email", F.concat(F.array(row(kind, F.lower(value))), labels)).otherwise(F.array(row(kind, plain)))


def redrawn(c: Column, digest: Column) -> Column:
    """Each digit of c another digit, each ASCII letter a letter of the same case; other characters stay."""
    figures = F.translate(digest, "abcdef", "274905")
    letters = F.translate(digest, "0123456789abcdef", "bcdfghklmnprstvz")

    def one(x: Column, i: Column) -> Column:
        at = i % 128 + 1
        letter = letters.substr(F.lit(129) - at, F.lit(1))
        return F.when(x.rlike("[0-9]"), figures.substr(at, F.lit(1))).when(x.rlike("[a-z]"), letter).when(x.rlike("[A-Z]"), F.upper(letter)).otherwise(x)

    return F.array_join(F.transform(F.split(c, ""), one), "")


def with_check(prefix: Column, valid: bool) -> Column:
    """prefix and a last digit that makes the Luhn sum right, or wrong."""
    full = F.transform(F.array(*(F.lit(str(d)) for d in range(10))), lambda d: F.concat(prefix, d))
    return F.element_at(F.filter(full, lambda x: F.call_function("luhn_check", x) if valid else ~F.call_function("luhn_check", x)), 1)


def iban(country: Column, account: Column) -> Column:
    """country, check digits and account."""
    value = lambda x: F.when(x.rlike("[0-9]"), F.ascii(x) - 48).otherwise(F.ascii(x) - 55)
    step = lambda s, x: (s * F.when(value(x) > 9, 100).otherwise(10) + value(x)) % 97
    rest = F.aggregate(F.split(F.concat(account, country, F.lit("00")), ""), F.lit(0), step)
    return F.concat(country, F.lpad((F.lit(98) - rest).cast("string"), 2, "0"), account)


def surrogate(key: str, kind: Column, entity: Column, gender: Column, draw: Column) -> Column:
    """The canonical surrogate of a part. Cards and account numbers keep their issuer or country, an address its domain (for now)."""
    digest = hexes(key, kind, entity, draw.cast("string"))
    body = lambda c: redrawn(c, digest)
    more = F.translate(F.substring(digest, 100, 20), "0123456789abcdef", "bcdfghklmnprstvz").substr(F.lit(1), F.floor(draw / LONGER).cast("int"))
    known = F.lit(None).cast("string")
    for (sex, _), names in GIVEN.items():
        known = F.when(entity.isin(*(n.lower() for n in names)), sex).otherwise(known)
    sex = F.coalesce(gender, known, F.when(number(digest, 61, 2) == 0, "male").otherwise("female"))

    def given(script: str) -> Column:
        # a table of names is soon used up: then a syllable makes a name a new one
        name = F.when(sex == "male", pick(GIVEN["male", script], digest, 1)).otherwise(pick(GIVEN["female", script], digest, 1))
        return F.when(draw < LONGER, name).otherwise(F.concat(F.initcap(pick(SYLLABLES[script], digest, 7)), F.when(draw >= 2 * LONGER, pick(SYLLABLES[script], digest, 13)).otherwise(""), F.when(draw >= 3 * LONGER, pick(SYLLABLES[script], digest, 19)).otherwise(""), F.lower(name)))

    def family(script: str) -> Column:
        return F.initcap(F.concat(*(pick(SYLLABLES[script], digest, 7 + 6 * k) for k in range(4)), F.when(draw >= LONGER, pick(SYLLABLES[script], digest, 31)).otherwise("")))

    local = F.substring_index(entity, "@", 1)
    return (
        F.when(kind == "email", F.concat(body(local), more, F.lit("@"), F.substring_index(entity, "@", -1)))
        .when(kind == "label", F.concat(body(entity), more))
        .when(kind == "given:latin", given("latin"))
        .when(kind == "given:cyrillic", given("cyrillic"))
        .when(kind == "family:latin", family("latin"))
        .when(kind == "family:cyrillic", family("cyrillic"))
        .when(kind == "iban", iban(F.substring(entity, 1, 2), body(F.expr("substring(entity, 5)"))))
        .when(kind == "ip", F.concat_ws(".", pick(OCTETS, digest, 1), *(number(digest, 7 + 6 * k, 254) + 1 for k in range(3))))
        .when(kind == "card", with_check(F.concat(F.substring(entity, 1, 1), body(F.expr("substring(entity, 2, length(entity) - 2)"))), True))
        .when(kind == "number", with_check(F.concat(F.substring(entity, 1, 1), body(F.expr("substring(entity, 2, length(entity) - 2)"))), False))
        .when(kind == "ssn", F.concat(F.lpad((number(digest, 1, 665) + 1).cast("string"), 3, "0"), F.lpad((number(digest, 7, 99) + 1).cast("string"), 2, "0"), F.lpad((number(digest, 13, 9999) + 1).cast("string"), 4, "0")))
        .otherwise(body(entity))
    )


def rendered(kind: Column, value: Column, made: Column) -> Column:
    """Surrogates of a mention's parts in its format: its separators and upper case, its country code, its title."""
    first = F.get(made, F.lit(0))
    # how many of the mention's digits stand before the first that changes
    skip = F.when(kind == "phone", F.length(digits_only(value)) - F.length(first)).otherwise(F.lit(0))
    chars = F.split(value, "")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        fits = x.rlike("[0-9]") | ((kind == "iban") & x.rlike("[A-Z]"))
        new = F.when(fits & (s["n"] >= skip), first.substr(s["n"] - skip + 1, F.lit(1))).otherwise(x)
        return F.struct(F.concat(s["out"], new).alias("out"), (s["n"] + fits.cast("int")).alias("n"))

    filled = F.aggregate(chars, start, step, lambda s: s["out"])
    between = F.regexp_extract_all(untitled(value), F.lit("[ -]"), F.lit(0))
    name = F.array_join(F.transform(made, lambda m, i: F.concat(m, F.coalesce(F.get(between, i), F.lit("")))), "")
    title = F.regexp_extract(value, rf"^{TITLES} ", 0)
    labels = F.concat(F.slice(made, F.lit(2), F.size(made) - 1), F.array(F.lower(F.substring_index(value, ".", -1))))
    mail = F.concat(F.substring_index(first, "@", 1), F.lit("@"), F.array_join(labels, "."))
    cased = F.array_join(F.transform(F.split(mail, ""), lambda x, i: F.when(F.get(chars, i).rlike("[A-Z]"), F.upper(x)).otherwise(x)), "")
    return F.when(kind == "email", cased).when(kind == "name", F.concat(title, name)).when(kind == "ip", first).otherwise(filled)


def drawn(entities: DataFrame, key: str, work: Work) -> DataFrame:
    """entities(kind, entity, gender) with made: different surrogates that are no entities themselves.

    Names count as equal if they are so in lower case, and a given name may be no family name of the table, nor the reverse.
    """
    done = None
    space = lambda kind: F.when(kind.rlike("^(given|family):"), "name").otherwise(kind)
    parallel = entities.sparkSession.sparkContext.defaultParallelism * 4
    left = entities.withColumn("draw", F.lit(0))
    real = entities.select(space(F.col("kind")).alias("space"), F.col("entity").alias("form"), F.lit(1).alias("real")).distinct()
    for _ in range(DRAWS):
        made = surrogate(key, F.col("kind"), F.col("entity"), F.col("gender"), F.col("draw"))
        tried = left.repartition(parallel, "kind", "entity").withColumn("made", made).withColumn("space", space(F.col("kind"))).withColumn("form", F.lower("made"))
        tried = work.save(tried.withColumn("form", F.when(F.col("kind") == "iban", F.col("made")).otherwise(F.col("form"))), "drawn")
        marked = tried.join(real, ["space", "form"], "left")
        if done is not None:
            marked = marked.join(done.select("space", "form", F.lit(1).alias("had")), ["space", "form"], "left")
        else:
            marked = marked.withColumn("had", F.lit(None).cast("int"))
        place = F.row_number().over(Window.partitionBy("space", "form").orderBy("kind", "entity"))
        good = (place == 1) & F.col("real").isNull() & F.col("had").isNull()
        marked = work.save(marked.withColumn("good", good), "marked")
        fresh = marked.where("good").select("kind", "entity", "made", "space", "form")
        done = fresh if done is None else work.save(done.unionByName(fresh), "done")
        left = marked.where("not good").select("kind", "entity", "gender", (F.col("draw") + 1).alias("draw"))
        if left.isEmpty():
            return done.select("kind", "entity", "made")
    raise ValueError("too many entities for different surrogates")


def replace_entities(docs: DataFrame, *, text_col: str = "text", key: str = "riskframe", count_col: str = "n_entities") -> DataFrame:
    """docs with surrogates for the entities in text_col, and their number as count_col; all rows and columns stay.

    A null text stays null with 0 entities, an empty one empty. Equal texts change alike, and so do mentions of one entity in
    all texts. In a text with a name its words change wherever they stand alone in the same case, too, which may
    meet a common word that is somebody's name; they are not counted. Names without a title or a common given name are not found.
    The key should be secret: who has it can test guesses. A column count_col of docs is replaced.
    """
    work = Work(docs.sparkSession, "pii")
    text = F.col(text_col)
    mentions = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(f"({ENTITY})"), F.lit(1)))
    docs = docs.drop(count_col)
    held = docs.select(F.sha2(text, 256).alias("h"), mentions.alias("m")).where(F.size("m") > 0).dropDuplicates(["h"])
    found = held.select("h", F.posexplode("m").alias("k", "value")).withColumn("mention", kinds(F.col("value")))
    found = found.select("h", "k", "value", "mention", F.posexplode(parts(F.col("mention"), F.col("value"))).alias("slot", "p")).select("h", "k", "value", "mention", "slot", "p.*")
    found = work.save(found, "mentions")
    # a given name's gender: the one that most titles tell
    told = found.groupBy("kind", "entity").agg(F.count_if(F.col("gender") == "male").alias("m"), F.count_if(F.col("gender") == "female").alias("f"))
    gender = F.when(F.col("m") > F.col("f"), "male").when(F.col("f") > F.col("m"), "female")
    made = drawn(work.save(told.select("kind", "entity", gender.alias("gender")), "entities"), key, work)
    found = work.save(found.join(made, ["kind", "entity"]).select("h", "k", "value", "mention", "slot", "word", "made"), "made")
    one = found.groupBy("h", "k", "value", "mention").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "made"))), lambda x: x["made"]).alias("made"))
    shown = one.select("h", "k", rendered(F.col("mention"), F.col("value"), F.col("made")).alias("shown"))
    shown = shown.groupBy("h").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "shown"))), lambda x: x["shown"]).alias("__shown"))
    words = found.where("word is not null").groupBy("h", "word").agg(F.min("made").alias("made"))
    words = words.groupBy("h").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("word", "made")))).alias("__names"))
    shown = work.save(shown.join(words, "h", "left"), "shown").withColumnRenamed("h", "__h")
    # texts without an entity don't move; a hash is null there and joins with nothing
    with_one = text.rlike(HINT) & text.rlike(ENTITY)
    rest = docs.where(~F.coalesce(with_one, F.lit(False))).withColumn(count_col, F.lit(0))
    hit = docs.where(with_one).withColumn("__h", F.sha2(text, 256)).join(shown, "__h")
    between = F.split(text, ENTITY, -1)
    renamed = lambda s: F.when(F.col("__names").isNull(), s).otherwise(F.array_join(F.transform(F.split(s, EDGE, -1), lambda w: F.coalesce(F.try_element_at(F.col("__names"), w), w)), ""))
    new = F.array_join(F.transform(between, lambda s, i: F.concat(renamed(s), F.coalesce(F.get(F.col("__shown"), i), F.lit("")))), "")
    hit = hit.withColumn(text_col, new).withColumn(count_col, F.size("__shown")).select(*rest.columns)
    return hit.unionByName(rest)
