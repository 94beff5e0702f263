"""Text, title and date expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that mark a kind of document, in the order in which kinds are tried.
DOCUMENT_WORDS = {
    "id": ["aadhaar", "pan card", "passport", "voter", "driving licence", "license", "id card"],
    "invoice": ["invoice", "bill", "receipt", "gst", "amount due", "total amount"],
    "certificate": ["certificate", "award", "achievement", "completion", "degree", "marksheet"],
    "medical": ["prescription", "diagnosis", "report", "hospital", "patient", "medicine"],
    "financial": ["bank", "statement", "account", "balance", "salary", "tax"],
}
# The order in which kinds of documents are listed.
DOCUMENT_ORDER = ["id", "certificate", "medical", "financial", "invoice", "other"]
# Base titles per category, and titles for undated events with people.
TITLE_BASES = {
    "travel": ["Trip", "Vacation", "Getaway", "Adventure"],
    "people": ["Gathering", "Get Together", "Meetup"],
    "food": ["Food Outing", "Dining Experience"],
    "nature": ["Nature Trip", "Outdoor Adventure"],
    "buildings": ["City Visit", "Exploration"],
    "pets": ["Pet Moments"],
    "vehicles": ["Road Trip", "Drive"],
    "documents": ["Documents"],
    "screenshots": ["Screenshots"],
    "other": ["Moments", "Memories"],
}
FACE_TITLES = {1: ["Solo Moments"], 2: ["Together"], 3: ["Group Gathering", "Friends Meetup", "Family Time"]}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def contains_any(c: Column | str, words: list[str]) -> Column:
    """Case-insensitive substring test against any of the words; false for null."""
    low = F.lower(_col(c))
    return F.coalesce(reduce(lambda a, b: a | b, (F.contains(low, F.lit(w.lower())) for w in words), F.lit(False)), F.lit(False))


def document_type(c: Column | str, words: dict[str, list[str]] | None = None) -> Column:
    """The first kind one of whose words is in the text, else "other"."""
    chain = None
    for kind, some in (words or DOCUMENT_WORDS).items():
        test = contains_any(c, some)
        chain = F.when(test, kind) if chain is None else chain.when(test, kind)
    return chain.otherwise("other")


def tokens(c: Column | str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(_col(c)), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


def _begins(word: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.startswith(word, F.lit(t)) for t in terms), F.lit(False))


def prefix_match(words: Column, terms: list[str]) -> Column:
    """Whether every term begins one of the words."""

    def some(term: str) -> Column:
        return F.exists(words, lambda w: _begins(w, [term]))

    return reduce(lambda a, b: a & b, map(some, terms), F.lit(True))


def prefix_hits(words: Column, terms: list[str]) -> Column:
    """How many words begin with some term."""
    return F.size(F.filter(words, lambda w: _begins(w, terms)))


def sized_url(url: Column | str, transform: str) -> Column:
    """A media URL with a transformation after its first /upload/."""
    return F.regexp_replace(_col(url), "^(.*?)/upload/", f"$1/upload/{transform}/")


def duration_days(start: Column | str, end: Column | str) -> Column:
    """Days between two times, rounded half up and at least 1; 1 for equal times, null if one is null."""
    seconds = F.unix_micros(_col(end).cast("timestamp")) - F.unix_micros(_col(start).cast("timestamp"))
    return F.when(_col(start).isNotNull() & _col(end).isNotNull(), F.greatest(F.lit(1), F.floor(seconds / 86_400_000_000 + 0.5))).cast("long")


def title(slug: Column | str, start: Column | str, people: Column | str, key: Column | str) -> Column:
    """An event's title from its leading category, start, number of people and an id that picks an option."""
    slug, start, people, key = map(_col, (slug, start, people, key))

    def pick(options: list[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, options)), (F.pmod(key, F.lit(len(options))) + 1).cast("int"))

    base = None
    for name, options in TITLE_BASES.items():
        base = F.when(slug == name, pick(options)) if base is None else base.when(slug == name, pick(options))
    base = base.otherwise(pick(TITLE_BASES["other"]))
    faces = F.when(people == 1, pick(FACE_TITLES[1])).when(people == 2, pick(FACE_TITLES[2])).otherwise(pick(FACE_TITLES[3]))
    return F.when(start.isNotNull(), F.concat(F.date_format(start, "MMM yyyy"), F.lit(" "), base)).when((people > 0) & (slug == "people"), faces).otherwise(base)


def stamp(c: Column | str) -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd HH:mm:ss")


def month_key(c: Column | str) -> Column:
    """YYYY-MM, the month padded to two digits."""
    return F.concat_ws("-", F.year(_col(c)).cast("string"), F.lpad(F.month(_col(c)).cast("string"), 2, "0"))


def month_name(c: Column | str) -> Column:
    """The month of a time as a heading, like "May 2024"."""
    return F.date_format(_col(c), "MMMM yyyy")


def ago(c: Column | str, now: Column | str) -> Column:
    """How long a time lies before now: minutes, hours or days, and its date from a week on."""
    seconds = F.floor((F.unix_micros(_col(now).cast("timestamp")) - F.unix_micros(_col(c).cast("timestamp"))) / 1_000_000)
    chain = F.when(seconds < 60, F.lit("just now"))
    for unit, size, limit in (("m", 60, 3_600), ("h", 3_600, 86_400), ("d", 86_400, 604_800)):
        chain = chain.when(seconds < limit, F.concat(F.floor(seconds / size).cast("string"), F.lit(f"{unit} ago")))
    return chain.otherwise(F.date_format(_col(c), "MMM d, yyyy"))


def human_bytes(c: Column | str) -> Column:
    """A size in B, KB, MB or GB with one decimal."""
    n = _col(c).cast("double")
    chain = F.when(n < 1024, F.concat(F.format_string("%.0f", n), F.lit(" B")))
    for power, unit in ((1, "KB"), (2, "MB")):
        chain = chain.when(n < 1024.0 ** (power + 1), F.concat(F.format_string("%.1f", n / 1024.0**power), F.lit(f" {unit}")))
    return chain.otherwise(F.concat(F.format_string("%.1f", n / 1024.0**3), F.lit(" GB")))


def unit_confidence(c: Column | str) -> Column:
    """A confidence between 0 and 1: more than 1 is per cent, and none is 0."""
    n = F.coalesce(_col(c).cast("double"), F.lit(0.0))
    return F.when(n > 1, n / 100).otherwise(n)


def error_text(c: Column | str) -> Column:
    """The first 1,000 characters of an error."""
    return F.substring(_col(c), 1, 1000)


def recognised(rows: DataFrame) -> DataFrame:
    """The rows of recognised text (raw_text, language, confidence, ...) that are to be stored: those with
    any text, the confidence between 0 and 1, and the language "eng" where none is given."""
    language = F.coalesce(F.nullif(F.col("language"), F.lit("")), F.lit("eng"))
    return rows.where(F.length("raw_text") > 0).withColumns({"confidence": unit_confidence("confidence"), "language": language})
