"""Publication dates in page text."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.text import lower_tr
from lexmill.schema import PageParams

# Month names in order.
MONTHS = ("ocak", "şubat", "mart", "nisan", "mayıs", "haziran", "temmuz", "ağustos", "eylül", "ekim", "kasım", "aralık")

_GAP = r"\s*\n?\s*"
_NAMES = "|".join(MONTHS)
WRITTEN = rf"(?U)(\d{{1,2}}){_GAP}({_NAMES}){_GAP}(\d{{4}})"
DOTTED = r"(?U)\b(\d{2})\.(\d{2})\.(\d{4})\b"
BADGE = rf"(?U)\b(\d{{1,2}}){_GAP}({_NAMES})\b(?!{_GAP}\d{{4}})"


def _month(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, MONTHS)), name).cast("int")


def _date(year: Column, month: Column, day: Column) -> Column:
    text = F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int"))
    return F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyy-MM-dd")


def published_at(text: Column, today: datetime.date, badge: Column | bool = False, p: PageParams = PageParams()) -> Column:
    """'12 Ağustos 2026' or '12.08.2026' as 2026-08-12, wherever it stands; where badge holds, also a day and month
    without a year near the top: this year, or the year before if that lies more than future_days ahead of today.
    Impossible dates and null texts give null. Months match in any case."""
    low = lower_tr(text)
    part = lambda c, pattern, i: F.regexp_extract(c, pattern, i)
    written = F.when(low.rlike(WRITTEN), _date(part(low, WRITTEN, 3), _month(part(low, WRITTEN, 2)), part(low, WRITTEN, 1)))
    dotted = F.when(low.rlike(DOTTED), _date(part(low, DOTTED, 3), part(low, DOTTED, 2), part(low, DOTTED, 1)))
    top = F.substring(low, 1, p.badge_chars)
    latest = F.lit((today + datetime.timedelta(days=p.future_days)).isoformat())
    guess = lambda year: _date(F.lit(year), _month(part(top, BADGE, 2)), part(top, BADGE, 1))
    near = F.when(top.rlike(BADGE), F.coalesce(*[F.when(guess(y) <= latest, guess(y)) for y in (today.year, today.year - 1)]))
    badge = badge if isinstance(badge, Column) else F.lit(badge)
    return F.when(low.rlike(WRITTEN), written).when(low.rlike(DOTTED), dotted).when(badge, near)
