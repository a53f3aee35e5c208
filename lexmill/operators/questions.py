"""Understanding of questions: redirect rules, follow-ups, names and intents, as expressions over many conversations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.functions.text import any_substring, lines_of, normalize_tr, strip, tokenize_tr

# Topics that other systems answer, in order; the first that matches wins. The answers are a parameter.
REDIRECTS = (
    ("student_system", ("not", "notlar", "notum", "transkript", "ders kaydi", "ders secme", "kayit yenileme ekrani", "obs", "ogrenci bilgi sistemi", "vize notu", "harf notu")),
    ("distance_learning", ("uzaktan egitim", "lms", "canli ders", "ders videosu", "online ders")),
    ("library", ("kutuphane", "kitap", "odunc", "veritabani")),
    ("admissions", ("taban puan", "kontenjan", "aday ogrenci", "tercih", "siralama", "yks")),
    ("alumni", ("mezun", "diploma")),
    ("courses", ("sertifika programi", "kurs")),
)
# Openings, pronouns and connectives of follow-up questions.
OPENINGS = ("peki", "ya ", "o zaman", "ayrica", "bir de", "aynisi", "ya da", "peki ya")
PRONOUNS = ("onun", "onlarin", "bunun", "sunun", "orada", "orasi", "bunlar", "onlar", "bolumun", "bolumde", "orasinin", "oranin")
CONNECTIVES = r"(?iU)^\s*(?:(?:peki\s+ya|peki|ya|bir\s+de|ayrıca|o\s+zaman|e\s+)\s+)+(?=\S)"
SHORT_QUESTION = 5
# Words by which questions ask for a field, for a person's identity, or for something else.
INTENTS = (
    ("phone", ("telefon", "numara", "tel", "iletisim numarasi", "santral", "dahili")),
    ("email", ("e-posta", "eposta", "mail", "email", "elektronik posta")),
    ("address", ("adres", "nerede", "konum", "hangi binada")),
)
IDENTITY = ("kimdir", "kim", "hangi bolum", "hangi bolumde", "nerede calis", "unvani", "gorevi ne", "hangi birim")
OTHER_FIELDS = ("ders", "telefon", "mail", "posta", "numara", "adres")
NAME_STOPS = tuple(
    "kim kimdir kimler nedir ne hangi bolum bolumu bolumde hoca hocasi unvani unvan gorevi gorevli calisiyor calisir nerede kisi veriyor dersleri ders mi midir adli isimli".split()
)
TITLES = ("Prof. Dr.", "Doç. Dr.", "Dr. Öğr. Üyesi", "Öğr. Gör. Dr.", "Öğr. Gör.", "Arş. Gör. Dr.", "Arş. Gör.", "Uzm.", "Okutman")
QUESTION_WORDS = ("kim", "kimdir", "kimler", "nedir", "ne", "nasil", "nasıl", "nerede", "hangi", "kac", "kaç", "zaman", "bolum", "bölüm")


def redirect(question: Column, rules=REDIRECTS) -> Column:
    """The first rule one of whose keywords begins at a word of the question; null without a match. Suffixes may
    follow a keyword, so only its start must be the start of a word."""
    text = normalize_tr(question)
    out = None
    for name, keywords in rules:
        words = "|".join(r"\s+".join(_quote(w) for w in k.split()) for k in keywords)
        hit = text.rlike(rf"(?<![a-z0-9_])(?:{words})")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out if out is not None else F.lit(None).cast("string")


def _quote(word: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in word)


def is_follow_up(question: Column) -> Column:
    text = normalize_tr(question)
    words = F.filter(F.split(text, " "), lambda w: w != "")
    opens = text.rlike(rf"^(?:{'|'.join(_quote_all(o.strip()) for o in OPENINGS)})")
    return opens | F.arrays_overlap(words, F.array(*map(F.lit, PRONOUNS))) | (F.size(words) <= SHORT_QUESTION)


def _quote_all(phrase: str) -> str:
    return " ".join(_quote(w) for w in phrase.split(" "))


def without_connectives(question: Column) -> Column:
    """Leading connectives go; what is left is never empty."""
    return strip(F.regexp_replace(question, CONNECTIVES, ""))


def unit_finder(units: DataFrame) -> Callable[[Column], Column]:
    """A function from a normalised text to the longest of units(unit) whose normalised name stands in it; ties to the
    first in code-point order, null without one. Blank names and null texts give none.

    An automaton over the names passes a text once, however many units there are. Unit names are a rule table: their
    number is that of the organisation, not of the corpus, and only distinct names travel."""
    known = units.filter(F.trim(F.coalesce("unit", F.lit(""))) != "").select("unit").distinct()
    best: dict[str, tuple[int, str]] = {}
    for unit, normal in known.select("unit", normalize_tr(F.col("unit"))).toLocalIterator():
        if normal:
            best[normal] = min(best.get(normal, (0, "")), (-len(unit), unit))
    shared = units.sparkSession.sparkContext.broadcast(best)

    @F.pandas_udf("string")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for normal, value in shared.value.items():
            automaton.add_word(normal, value)
        if shared.value:
            automaton.make_automaton()
        for texts in batches:
            found = [min((v for _, v in automaton.iter(t)), default=(0, None))[1] if t and shared.value else None for t in texts]
            yield pd.Series(found, dtype=object)

    return find


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): each user row with the first assistant row before the next user row. Other
    roles take no part; a question without an answer has a null one."""
    said = conversations.filter(F.col("role").isin("user", "assistant"))
    w = W.partitionBy("conv_id").orderBy("turn", F.desc("role"))
    nth = said.withColumn("q", F.sum((F.col("role") == "user").cast("long")).over(w)).filter("q > 0")
    first = F.min(F.when(F.col("role") == "assistant", F.struct("turn", "text")))
    asked = F.min(F.when(F.col("role") == "user", F.struct("turn", "text")))
    return nth.groupBy("conv_id", "q").agg(asked.alias("u"), first.alias("a")).select("conv_id", F.col("u.turn").alias("turn"), F.col("u.text").alias("question"), F.col("a.text").alias("answer"))


def rewrite(asked: DataFrame, units: DataFrame, history: int = 3) -> DataFrame:
    """asked(conv_id, turn, question, answer, ...) with follow_up, topic and search_question. A follow-up loses its
    connectives and, unless it names a unit, gets in front the newest unit of the last turns: in a question, else in
    its answer. A null question stays null; a first turn has no history."""
    plain, longest_unit = without_connectives(F.col("question")), unit_finder(units)
    low = {f"__{n}": normalize_tr(F.coalesce(c, F.lit(""))) for n, c in (("q", F.col("question")), ("a", F.col("answer")), ("p", plain))}
    asked = asked.withColumns(low)
    heard = F.coalesce(longest_unit(F.col("__q")), longest_unit(F.col("__a")))
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(-history, -1)
    out = asked.withColumn("__heard", heard).withColumn("__before", F.last("__heard", ignorenulls=True).over(w))
    topic = F.when(F.col("follow_up") & longest_unit(F.col("__p")).isNull(), F.col("__before"))
    out = out.withColumn("follow_up", is_follow_up(F.col("question"))).withColumn("topic", topic)
    search = F.when(F.col("follow_up"), F.concat_ws(" ", "topic", plain)).otherwise(F.col("question"))
    return out.withColumn("search_question", search).drop("__heard", "__before", *low)


def intent(question: Column) -> Column:
    """phone, email, address, or null: the first whose words stand in the question."""
    text = normalize_tr(question)
    out = None
    for name, parts in INTENTS:
        out = F.when(any_substring(text, parts), name) if out is None else out.when(any_substring(text, parts), name)
    return out


def asks_identity(question: Column) -> Column:
    return ~asks_other_field(question) & any_substring(normalize_tr(question), IDENTITY)


def asks_other_field(question: Column) -> Column:
    """Whether a word begins with the name of another field; names of people may hold one inside."""
    return normalize_tr(question).rlike(rf"(?<![a-z0-9_])e?(?:{'|'.join(OTHER_FIELDS)})")


def name_parts(question: Column) -> Column:
    """Words of a question that may be parts of a name, normalised: longer than two letters, no question words."""
    words = F.filter(F.regexp_extract_all(question, F.lit(r"(?U)\w+"), F.lit(0)), lambda w: F.length(w) > 2)
    return F.filter(F.transform(words, lambda w: normalize_tr(w, compatibility=False)), lambda w: ~w.isin(*NAME_STOPS))


def looks_like_person(question: Column) -> Column:
    """Two capitalised words in a row, or a who-question with two more words."""
    pair = question.rlike(r"\b[A-ZÇĞİÖŞÜ][a-zçğıöşü]+\s+[A-ZÇĞİÖŞÜ][a-zçğıöşü]+")
    who = question.rlike(r"(?iU)\b(?:kimdir|kim)\b")
    rest = F.filter(F.regexp_extract_all(F.lower(question), F.lit(r"(?U)\w+"), F.lit(0)), lambda w: ~w.isin(*QUESTION_WORDS))
    return pair | (who & (F.size(rest) >= 2))


def staff_names(chunks: DataFrame, longest: int = 60) -> DataFrame:
    """Distinct (name) of staff chunks: sorted token arrays of at least two, from titles and from short segments that
    follow an academic title."""
    title_words = sorted({w for t in TITLES for w in "".join(c if c.isalnum() else " " for c in t).split()})
    drop = F.array(*[F.lit(x) for x in sorted({_plain(w) for w in title_words})])
    staff = chunks.filter(F.col("doc_type") == "personel")
    segments = F.filter(F.transform(F.split("text", r"[|\n]", -1), strip), lambda s: (s != "") & (F.length(s) < longest))
    lines = staff.select(F.explode(F.concat(F.array(F.coalesce("title", F.lit(""))), F.coalesce(segments, F.array().cast("array<string>")))).alias("line"))
    rest = None
    for t in TITLES:
        after = F.substring_index(F.col("line"), t, -1) if t.count(t[0]) < 1 else F.expr(f"substr(line, instr(line, '{t}') + {len(t)})")
        rest = F.when(F.col("line").contains(t), after) if rest is None else rest.when(F.col("line").contains(t), after)
    name = F.array_sort(F.array_except(F.array_distinct(tokenize_tr(rest)), drop))
    return lines.filter(rest.isNotNull()).select(name.alias("name")).filter(F.size("name") >= 2).distinct()


def _plain(word: str) -> str:
    return word.translate(str.maketrans("İIŞĞÜÖÇ", "iışğüöç")).lower().translate(str.maketrans("şğüöçıâîû", "sguociaiu"))


def names_staff(queries: DataFrame, names: DataFrame) -> DataFrame:
    """queries(query_id, text, ...) with named: whether all tokens of some staff name stand in the text. Each name is
    joined on the token that the fewest names hold, so that a common name part is no key, then compared whole."""
    tokens = queries.select("query_id", F.array_distinct(tokenize_tr(F.coalesce("text", F.lit("")))).alias("tokens"))
    each = names.select("name", F.explode("name").alias("key"))
    counted = each.join(each.groupBy("key").agg(F.count("*").alias("n")), "key")
    keyed = counted.groupBy("name").agg(F.min(F.struct("n", "key")).alias("rarest")).select("name", "rarest.key")
    hits = tokens.select("query_id", "tokens", F.explode("tokens").alias("key")).join(keyed, "key")
    named = hits.filter(F.size(F.array_except("name", "tokens")) == 0).select("query_id").distinct().withColumn("named", F.lit(True))
    return queries.join(named, "query_id", "left").withColumn("named", F.coalesce("named", F.lit(False)))


def segments_of(text: Column) -> Column:
    return F.transform(F.split(text, r"[|\n]", -1), strip)


def stripped_lines(text: Column) -> Column:
    return F.transform(lines_of(text), strip)
