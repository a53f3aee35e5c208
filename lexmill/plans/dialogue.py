"""Queries of questions, answers and the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import normalize_tr
from lexmill.operators import answers, evaluation, questions
from lexmill.plans.tables import lower_sql, norm_sql, strip_sql, table

# Rules and units over the driver's invented words.
RULES = (("english", ("the", "that of")), ("french", ("le", "la", "est")), ("german", ("der", "die")), ("spanish", ("el", "los")))
UNITS = ("in", "the", "la", "der", "une", "tion in")


def redirect_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule that answers each user turn, if any."""
    users = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return users.select("conv_id", "turn", questions.redirect(F.col("text"), RULES).alias("target"))


REDIRECT_RULES_SQL = f"""
select conv_id, turn, case {" ".join("when regexp_matches(" + norm_sql("text") + ", '(^|[^a-z0-9_])(" + "|".join(k.replace(" ", "\\s+") for k in ks) + ")') then '" + name + "'" for name, ks in RULES)} end target
from conversations where role = 'user'"""


def followup_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each question is a follow-up, the topic it takes over, and what is searched for."""
    units = spark.createDataFrame([(u,) for u in UNITS], "unit string")
    asked = questions.turns(table(spark, sf_dir, "conversations"))
    return questions.rewrite(asked, units).select("conv_id", "turn", "follow_up", "topic", F.md5("search_question").alias("search_md5"))


_LONGEST = sorted(UNITS, key=lambda u: (-len(u), u))


def _unit_sql(x: str) -> str:
    return "case " + " ".join(f"when contains({norm_sql(x)}, '{u}') then '{u}'" for u in _LONGEST) + " end"


_OPEN = "|".join(sorted({o.strip() for o in questions.OPENINGS}))
_PRONOUNS = "[" + ", ".join(f"'{p}'" for p in questions.PRONOUNS) + "]"
FOLLOWUP_REWRITE_SQL = f"""
with s as (select *, sum((role = 'user')::int) over (partition by conv_id order by turn, role desc) q from conversations where role in ('user', 'assistant')),
t as (select conv_id, min(turn) filter (role = 'user') turn, arg_min(text, turn) filter (role = 'user') question, arg_min(text, turn) filter (role = 'assistant') answer from s where q > 0 group by conv_id, q),
f as (select *, regexp_matches({norm_sql("question")}, '^({_OPEN})') or list_has_any(string_split({norm_sql("question")}, ' '), {_PRONOUNS})
    or len(list_filter(string_split({norm_sql("question")}, ' '), lambda x: x <> '')) <= 5 follow_up,
    coalesce({_unit_sql("question")}, {_unit_sql("coalesce(answer, '')")}) heard,
    {strip_sql("regexp_replace(question, '(?i)^\\s*((peki\\s+ya|peki|ya|bir\\s+de|ayrıca|o\\s+zaman|e\\s+)\\s+)+', '')")} plain from t),
b as (select *, case when follow_up and {_unit_sql("plain")} is null then last_value(heard ignore nulls) over (partition by conv_id order by turn rows between 3 preceding and 1 preceding) end topic from f)
select conv_id, turn, follow_up, topic, md5(case when not follow_up then question when topic is null then plain else topic || ' ' || plain end) search_md5 from b"""


def contact_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses and phone numbers in every document, and what it asks for."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", answers.email(text).alias("email"), answers.phone(text).alias("phone"), questions.intent(text).alias("intent"), answers.knows_nothing(text).alias("unknown"))


def _any_sql(x: str, parts) -> str:
    return "(" + " or ".join(f"contains({x}, '{p}')" for p in parts) + ")"


CONTACT_EXTRACT_SQL = f"""
with n as (select doc_id, text, {norm_sql("text")} norm,
    list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip_sql("x")}), lambda x: starts_with({norm_sql("x")}, 'telefon')) l from documents)
select doc_id, nullif(regexp_extract(text, '[\\p{{L}}\\p{{N}}_.-]+@[\\p{{L}}\\p{{N}}_.-]+\\.(?:edu\\.tr|com|org|gov\\.tr)'), '') email,
  nullif(trim(regexp_replace(regexp_extract(text, '0\\s*\\(?\\s*\\d{{3}}\\s*\\)?[\\s\\d]{{7,14}}\\d'), '\\s+', ' ', 'g')), '') phone,
  case {" ".join(f"when {_any_sql('norm', parts)} then '{name}'" for name, parts in questions.INTENTS)} end intent,
  {_any_sql(lower_sql("text"), answers.UNKNOWN)} "unknown" from n"""


def question_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each user turn is read: intent, identity question, person, parts of a name."""
    t = F.col("text")
    users = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return users.select("conv_id", "turn", questions.intent(t).alias("intent"), questions.asks_identity(t).alias("identity"), questions.looks_like_person(t).alias("person"), F.length(normalize_tr(t)).cast("long").alias("n_norm"))


QUESTION_KINDS_SQL = f"""
with n as (select *, {norm_sql("text")} norm from conversations where role = 'user')
select conv_id, turn, case {" ".join(f"when {_any_sql('norm', parts)} then '{name}'" for name, parts in questions.INTENTS)} end intent,
  not regexp_matches(norm, '(^|[^a-z0-9_])e?({"|".join(questions.OTHER_FIELDS)})') and {_any_sql("norm", questions.IDENTITY)} "identity",
  regexp_matches(text, '(^|[^\\p{{L}}\\p{{N}}_])[A-ZÇĞİÖŞÜ][a-zçğıöşü]+\\s+[A-ZÇĞİÖŞÜ][a-zçğıöşü]+') or (regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}_])(kimdir|kim)([^\\p{{L}}\\p{{N}}_]|$)')
    and len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w not in ({", ".join(f"'{w}'" for w in questions.QUESTION_WORDS)}))) >= 2) person,
  length(norm) n_norm from n"""


def unanswered_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the log of unanswered questions: each day's events of a kind, with the largest values as logged."""
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    return table(spark, sf_dir, "events").groupBy(day, "event_type").agg(F.count("*").alias("n"), F.bround(F.max("value"), 2).alias("most"), F.countDistinct("user_id").alias("users"))


UNANSWERED_LOG_SQL = """
select strftime(ts, '%Y-%m-%d') as "day", event_type, count(*) n, round_even(max("value"), 2) most, count(distinct user_id) users from events group by 1, 2"""


def answer_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as answers of models named after the length of a conversation: accuracy against the first word of
    the question before, direct answers and mean seconds."""
    asked = questions.turns(table(spark, sf_dir, "conversations")).withColumn("query_id", F.col("conv_id") * 1000 + F.col("turn"))
    gold = asked.select("query_id", F.element_at(F.split("question", "[ .,]"), 1).alias("expected"))
    model = F.when(F.length("question") > 120, "long").otherwise("short")
    answered = asked.select("query_id", "answer", model.alias("model"), F.when(F.col("answer").contains("\n"), "answered").otherwise("direct").alias("route"), (F.length("answer") / 100).alias("seconds"))
    return evaluation.answer_quality(answered, gold, "model")


ANSWER_QUALITY_SQL = f"""
with s as (select *, sum((role = 'user')::int) over (partition by conv_id order by turn, role desc) q from conversations where role in ('user', 'assistant')),
t as (select conv_id, arg_min(text, turn) filter (role = 'user') question, arg_min(text, turn) filter (role = 'assistant') answer from s where q > 0 group by conv_id, q)
select case when length(question) > 120 then 'long' else 'short' end model, count(*) n,
  round(avg(coalesce(contains({lower_sql("answer")}, {lower_sql("regexp_split_to_array(question, '[ .,]')[1]")}), false)::int), 6) accuracy,
  count(*) filter (not contains(answer, chr(10)) or answer is null) direct, round(avg(length(answer) / 100.0), 6) as "seconds"
from t group by 1"""

_ALL = (redirect_rules, followup_rewrite, contact_extract, question_kinds, unanswered_log, answer_quality)
QUERIES = {f.__name__: f for f in _ALL}
SQL = {name: globals()[f"{name.upper()}_SQL"].strip() for name in QUERIES}
