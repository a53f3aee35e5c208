"""Structured answers from ranked results, context packing and routing of questions."""

from __future__ import annotations

import datetime
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.functions.text import first_match, normalize_tr, squeeze, strip, word_count, words_of
from lexmill.operators.chunking import caseless
from lexmill.operators.questions import TITLES, asks_identity, asks_other_field, intent, looks_like_person, name_parts, segments_of, stripped_lines

# Patterns of fields, and what a generator says when it knows nothing.
PHONE = r"(?U)0\s*\(?\s*\d{3}\s*\)?[\s\d]{7,14}\d"
EMAIL = r"(?U)[\w.\-]+@[\w.\-]+\.(?:edu\.tr|com|org|gov\.tr)"
COURSE = r"(?U)\b([A-ZÇĞİÖŞÜ]{2,4}\s?\d{3,4})\b"
UNKNOWN = ("bilgi_yok", "elimde bilgi yok", "bilgi bulunmuyor", "bilmiyorum")
MIN_ADDRESS, MAX_STAFF_LINE = 15, 80
CONTEXT_WORDS, MIN_REST = 1100, 40


def labelled(text: Column, label: str) -> Column:
    """The value of a labelled field: what follows the label (and a remark in brackets, a colon) on the first line that
    begins with it, else the next filled line; null without either."""
    lines = stripped_lines(text)
    at = F.array_position(F.transform(lines, lambda s: F.startswith(normalize_tr(s, compatibility=False), normalize_tr(F.lit(label), compatibility=False))), True).cast("int")
    same = strip(F.regexp_replace(F.get(lines, at - 1), rf"(?iU)^{label}\s*(?:\([^)]*\))?\s*:?\s*", ""))
    following = F.get(F.filter(F.slice(lines, at + 1, F.size(lines)), lambda s: s != ""), F.lit(0))
    return F.when(at > 0, F.when(same != "", same).otherwise(following))


def phone(text: Column) -> Column:
    """From the labelled line, else from anywhere."""
    return squeeze(F.coalesce(first_match(labelled(text, "Telefon"), PHONE), first_match(text, PHONE)))


def email(text: Column) -> Column:
    return first_match(text, EMAIL)


def address(text: Column) -> Column:
    line = labelled(text, "Adres")
    return F.when(F.length(line) > MIN_ADDRESS, line)


def course_code(question: Column) -> Column:
    return first_match(question, COURSE, 1)


def course_row(text: Column, code: Column) -> Column:
    """struct<name, credits, coordinator> of the first bar-separated line whose first cell is the code; null without."""
    bare = lambda c: F.replace(normalize_tr(c, compatibility=False), F.lit(" "), F.lit(""))
    rows = F.transform(F.filter(F.split(text, "\n", -1), lambda s: s.contains("|")), lambda s: F.transform(F.split(s, r"\|", -1), strip))
    row = F.get(F.filter(rows, lambda r: bare(r[0]) == bare(code)), F.lit(0))
    cell = lambda i: F.coalesce(F.get(row, F.lit(i)), F.lit(""))
    return F.when(row.isNotNull(), F.struct(cell(1).alias("name"), cell(2).alias("credits"), cell(3).alias("coordinator")))


def staff_line(text: Column, parts: Column) -> Column:
    """The first short segment that begins with an academic title and holds every part of the name."""
    begins = lambda s: F.exists(F.array(*map(F.lit, TITLES)), lambda t: F.startswith(s, t))
    fits = lambda s: (s != "") & (F.length(s) <= MAX_STAFF_LINE) & begins(s) & F.forall(parts, lambda p: normalize_tr(s, compatibility=False).contains(p))
    return F.get(F.filter(segments_of(text), fits), F.lit(0))


def direct_answers(results: DataFrame, queries: DataFrame, home: str = "site") -> DataFrame:
    """(query_id, answer, kind, rank) for queries that a field of their results(query_id, rank, title, unit, text)
    answers: a person's identity, a course, or a contact field, in that order. queries(query_id, text, named): named
    tells that the text holds a staff name. home stands for a missing unit. rank is that of the source."""
    about = queries.select(
        "query_id",
        ((F.coalesce("named", F.lit(False)) & ~asks_other_field(F.col("text"))) | asks_identity(F.col("text"))).alias("identity"),
        name_parts(F.col("text")).alias("parts"),
        course_code(F.col("text")).alias("code"),
        intent(F.col("text")).alias("intent"),
    )
    r = results.select("query_id", "rank", "title", "unit", "text").join(about, "query_id")
    title, unit, text = normalize_tr(F.coalesce("title", F.lit("")), compatibility=False), F.coalesce("unit", F.lit(home)), F.col("text")
    person = F.col("identity") & (F.size("parts") >= 2)
    own = F.forall("parts", lambda p: title.contains(p))
    prefer = F.when(own, 0).when(title.contains("akademik personel"), 1).otherwise(2)
    line = F.when(person, staff_line(text, F.col("parts")))
    titled = F.exists(F.array(*[normalize_tr(F.lit(t), compatibility=False) for t in TITLES]), lambda t: title.contains(t))
    last = strip(F.substring_index("title", "—", -1))
    suffix = F.concat(F.lit(" — "), unit, F.lit(" akademik kadrosunda."))
    course = F.when(F.col("code").isNotNull(), course_row(text, F.col("code")))
    told = F.concat_ws(
        " ",
        F.concat(F.upper("code"), F.lit(" dersinin adı "), course["name"], F.lit(".")),
        F.when(course["credits"] != "", F.concat(F.lit("AKTS kredisi "), course["credits"], F.lit("."))),
        F.when(course["coordinator"] != "", F.concat(F.lit("Dersin koordinatörü "), course["coordinator"], F.lit("."))),
    )
    contact = caseless(F.coalesce("title", F.lit(""))).contains("iletişim")
    value = F.when(F.col("intent") == "phone", phone(text)).when(F.col("intent") == "email", email(text)).when(F.col("intent") == "address", address(text))
    label = F.when(F.col("intent") == "phone", " telefon numarası: ").when(F.col("intent") == "email", " e-posta adresi: ").otherwise(" adresi: ")
    offers = F.array(
        F.when(line.isNotNull(), F.struct(F.lit(0).alias("step"), prefer.alias("prefer"), "rank", F.concat(line, suffix).alias("answer"), F.lit("identity").alias("kind"))),
        F.when(person & own & titled, F.struct(F.lit(1).alias("step"), prefer.alias("prefer"), "rank", F.concat(last, suffix).alias("answer"), F.lit("identity").alias("kind"))),
        F.when(course.isNotNull(), F.struct(F.lit(2).alias("step"), F.lit(0).alias("prefer"), "rank", told.alias("answer"), F.lit("course").alias("kind"))),
        F.when(value.isNotNull(), F.struct(F.lit(3).alias("step"), F.when(contact, 0).otherwise(1).alias("prefer"), "rank", F.concat(unit, label, value).alias("answer"), F.col("intent").alias("kind"))),
    )
    best = r.select("query_id", F.explode(offers).alias("offer")).filter("offer is not null").groupBy("query_id").agg(F.min("offer").alias("o"))
    return best.select("query_id", "o.answer", "o.kind", "o.rank")


def pack_context(results: DataFrame, budget: int = CONTEXT_WORDS, least: int = MIN_REST) -> DataFrame:
    """results(query_id, rank, text, ...) that fit a budget of words, with text cut and words set: texts are taken in
    rank order; the first that does not fit is cut to what is left, if that is at least `least` words, and ends the
    context. Null texts count as empty."""
    sized = results.withColumn("text", strip(F.coalesce("text", F.lit("")))).withColumn("words", word_count(F.col("text")))
    before = F.coalesce(F.sum("words").over(W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.lit(budget) - F.col("__before")
    fits = F.col("words") <= left
    cut = F.concat(F.array_join(F.slice(words_of(F.col("text")), 1, F.greatest(left, F.lit(0)).cast("int")), " "), F.lit(" ..."))
    out = sized.withColumn("__before", before).filter((left > 0) & (fits | (left >= least)) | (F.col("words") == 0) & (left >= 0))
    return out.withColumns({"text": F.when(fits, F.col("text")).otherwise(cut), "words": F.when(fits, F.col("words")).otherwise(left)}).drop("__before")


def context_text(packed: DataFrame) -> DataFrame:
    """(query_id, context): numbered texts under title and date."""
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "title", F.when(F.coalesce("published_at", F.lit("")) != "", F.concat(F.lit(" ("), "published_at", F.lit(" tarihli)"))).otherwise(""))
    block = F.struct("rank", F.concat_ws("\n", head, "text").alias("block"))
    return packed.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda b: b["block"]), "\n\n").alias("context"))


def prompt(question: Column, context: Column, today: datetime.date) -> Column:
    return F.concat(F.lit(f"Bugünün tarihi: {today:%d.%m.%Y}\n\n--- BAGLAM ---\n"), F.coalesce(context, F.lit("")), F.lit("\n\n--- SORU ---\n"), question)


# Fixed value: what a generator writes when the context holds no answer; UNKNOWN looks for it.
MARKER = "BILGI_YOK"
SYSTEM = f"""Bir kurumun destek asistanısın. Sana numaralı metinlerden bir BAGLAM ve bir SORU verilir.
- Yalnız bağlamda yazanı söyle; tahmin etme, ekleme yapma. Bütün parçalara bak.
- Telefon, adres, tarih, kod ve adları bağlamda geçtiği gibi aktar.
- Türkçe, kısa ve açık yaz; liste istenirse maddeler hâlinde ver.
- Bağlam soruyu yanıtlamıyorsa yalnız {MARKER} yaz."""


class TextGenerator(Protocol):
    """Answers a batch of prompts; null for those that fail."""

    def __call__(self, prompts: list[str]) -> list[str | None]: ...


def echo(prompts: list[str]) -> list[str]:
    """The generator for tests: the first six lines of the context."""
    return ["\n".join([s for s in p.split("--- BAGLAM ---\n", 1)[-1].split("\n--- SORU ---", 1)[0].split("\n") if s.strip()][:6]) for p in prompts]


class ServedModel:
    """A generator that asks a chat model served over HTTP: a POST of {"model", "messages", "stream": false, "options"}
    for each prompt, a system message before it. The answer stands in the JSON that comes back, at the dotted path
    `answer`.

    At most `at_once` requests of a task run side by side. A request that the server refuses for the moment, breaks off
    or leaves without an answer is sent again, after a wait that doubles each time, until `attempts` or `deadline`
    seconds are spent; what then has no answer is null, and the other prompts keep theirs."""

    def __init__(self, url: str, model: str, system: str | None = SYSTEM, timeout: float = 120.0, answer: str = "message.content", at_once: int = 4, attempts: int = 3, wait: float = 0.5, deadline: float = 300.0, **options) -> None:
        self.url, self.model, self.system, self.timeout, self.answer = url, model, system, timeout, answer
        self.at_once, self.attempts, self.wait, self.deadline, self.options = at_once, attempts, wait, deadline, options

    def request(self, prompt: str) -> bytes:
        before = [{"role": "system", "content": self.system}] if self.system else []
        return json.dumps({"model": self.model, "messages": [*before, {"role": "user", "content": prompt}], "stream": False, "options": self.options}).encode()

    def one(self, prompt: str) -> str | None:
        ends = time.monotonic() + self.deadline
        for attempt in range(self.attempts):
            left = ends - time.monotonic()
            if left <= 0:
                break
            try:
                sent = urllib.request.Request(self.url, data=self.request(prompt), headers={"Content-Type": "application/json"})
                with urllib.request.urlopen(sent, timeout=min(self.timeout, left)) as r:
                    told = json.loads(r.read())
                for part in self.answer.split("."):
                    told = told[part]
                return str(told).strip()
            except urllib.error.HTTPError as e:
                if e.code < 500 and e.code not in (408, 425, 429):
                    break
            except (OSError, ValueError, KeyError, TypeError):
                pass
            if attempt + 1 < self.attempts:
                time.sleep(min(self.wait * 2**attempt, max(0.0, ends - time.monotonic())))
        return None

    def __call__(self, prompts: list[str]) -> list[str | None]:
        with ThreadPoolExecutor(self.at_once) as pool:
            return list(pool.map(self.one, prompts))


def generate(df: DataFrame, prompt_col: str, out: str, generator: TextGenerator, batch: int = 8) -> DataFrame:
    """df with a generator's answers, some prompts at a time on the executors. Null prompts get null, and so do the
    prompts of a call that fails, so that one failure is an answer of its own and not the end of the job."""

    def answered(prompts: list[str]) -> list:
        try:
            return list(generator(prompts))
        except Exception:
            return [None] * len(prompts) if len(prompts) == 1 else [x for p in prompts for x in answered([p])]

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        given = s.dropna().tolist()
        said = iter([x for at in range(0, len(given), batch) for x in answered(given[at : at + batch])])
        return pd.Series([None if p is None else next(said) for p in s], dtype=object)

    return df.withColumn(out, run(F.col(prompt_col)))


def knows_nothing(answer: Column) -> Column:
    low = caseless(answer)
    out = F.lit(False)
    for u in UNKNOWN:
        out = out | low.contains(u)
    return out


def sources(results: DataFrame, key: str = "url") -> DataFrame:
    """(query_id, sources): titles and URLs of results in rank order, each URL once."""
    first = results.groupBy("query_id", key).agg(F.min(F.struct("rank", "title")).alias("f"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("f.rank").alias("rank"), F.col("f.title").alias("title"), F.col(key).alias("url"))))
    return first.groupBy("query_id").agg(F.transform(ordered, lambda s: F.struct(s["title"].alias("title"), s["url"].alias("url"))).alias("sources"))


def route(queries: DataFrame, results: DataFrame, gate: DataFrame, today: datetime.date, generator: TextGenerator = echo, redirects: Column | None = None, k: int = 4, texts: dict[str, str] | None = None) -> DataFrame:
    """(query_id, route, answer, sources) of queries(query_id, text, search_text, named): redirect, direct, out_of_scope,
    not_recorded, answered, unknown or, where the generator failed, failed. texts has the answers of routes that end
    without one, by route; those it lacks are null. Only queries that no rule settles reach the generator, with the best k results.
    redirects is an expression over text that names a target, or null."""
    target = F.when(~F.coalesce("named", F.lit(False)), redirects if redirects is not None else F.lit(None).cast("string"))
    asked = queries.withColumn("target", target)
    direct = direct_answers(results, asked.filter("target is null").select("query_id", F.col("search_text").alias("text"), "named"))
    known = asked.join(direct.select("query_id", F.col("answer").alias("direct"), F.col("rank").alias("source_rank")), "query_id", "left").join(gate.select("query_id", "in_scope"), "query_id", "left")
    closed = F.when(looks_like_person(F.col("text")), "not_recorded").otherwise("out_of_scope")
    first = F.when(F.col("target").isNotNull(), "redirect").when(F.col("direct").isNotNull(), "direct").when(~F.coalesce("in_scope", F.lit(False)), closed)
    known = known.withColumn("route", first)
    open_ = known.filter("route is null").select("query_id", "search_text")
    best = results.join(open_, "query_id").filter(F.col("rank") <= k)
    contexts = open_.join(context_text(pack_context(best)), "query_id", "left").select("query_id", prompt(F.col("search_text"), F.col("context"), today).alias("prompt"))
    said = generate(contexts, "prompt", "said", generator).select("query_id", "said").withColumn("unknown", knows_nothing(F.col("said")))
    out = known.join(said, "query_id", "left")
    kind = F.coalesce("route", F.when(F.col("said").isNull(), "failed").when(F.col("unknown"), "unknown").otherwise("answered"))
    answer = F.when(F.col("route") == "redirect", F.col("target")).when(F.col("route") == "direct", F.col("direct")).when(kind == "answered", F.col("said"))
    for name, told in (texts or {}).items():
        answer = answer.when(kind == name, told)
    shown = results.join(out.filter("route = 'direct'").select("query_id", F.col("source_rank").alias("rank")), ["query_id", "rank"], "left_semi")
    shown = shown.unionByName(best.drop("search_text").join(out.filter("route is null and said is not null and not unknown").select("query_id"), "query_id", "left_semi"))
    final = out.select("query_id", kind.alias("route"), answer.alias("answer"))
    return final.join(sources(shown), "query_id", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<struct<title:string,url:string>>")))


def unanswered(routed: DataFrame, queries: DataFrame, gate: DataFrame, asked_at: str) -> DataFrame:
    """Log rows of questions without an answer: asked_at, question, search_question, reason, bm25_max, cosine_max."""
    lost = routed.filter(F.col("route").isin("out_of_scope", "not_recorded", "unknown", "failed")).select("query_id", F.col("route").alias("reason"))
    rows = lost.join(queries.select("query_id", F.col("text").alias("question"), F.col("search_text").alias("search_question")), "query_id").join(gate, "query_id", "left")
    return rows.select(F.lit(asked_at).alias("asked_at"), "question", "search_question", "reason", F.bround("bm25_max", 2).alias("bm25_max"), F.bround("cosine_max", 3).alias("cosine_max"))


GENERATORS: dict[str, Callable] = {"echo": echo}
