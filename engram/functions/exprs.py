"""Column builders; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no keywords.
STOPWORDS = (
    "a an the and or but in on at to for of with by from is was are were be been being have has had do does did "
    "will would could should may might can its it this that these those my your his her our their i we you he she they as if"
).split()
# Markers of negation, matched anywhere in a text.
NEGATIONS = ["not", "n't", "never", "no longer", "stopped", "quit", "dislikes", "dislike", "hates", "hate", "doesn't", "don't", "without"]
# Phrases that recall an earlier session.
RECALL_PATTERNS = [
    r"\blast time\b",
    r"\bwe (discussed|talked about|decided|considered)\b",
    r"\bwhat did we\b",
    r"\bcontinue from where we left off\b",
    r"\bprevious(ly)? (session|conversation|discussion)\b",
    r"\bwhat have we (discussed|covered|talked about)\b",
    r"\bremind me what\b",
    r"\bearlier (session|conversation|we)\b",
    r"\bwhat was (the|our) (plan|design|decision|approach)\b",
]
# Types of nodes, and relations with their default weights.
NODE_TYPES = ["Person", "Project", "Technology", "Organization", "Place", "Event", "Concept"]
RELATIONS = {
    "uses": 0.7, "built_with": 0.8, "depends_on": 0.75, "contains": 0.7, "created": 0.8, "replaced": 0.75, "part_of": 0.7, "related_to": 0.4,
    "located_in": 0.65, "knows": 0.5, "worked_on": 0.7, "prefers": 0.6, "learned": 0.6, "mentions": 0.3, "contradicts": 0.5,
}
SYMMETRIC = ["related_to", "knows", "contradicts"]
# Days that a reflection lives, by scope and specificity.
REFLECTION_DAYS = {("session", "narrow"): 7, ("session", "general"): 14, ("project", "narrow"): 45, ("project", "general"): 90, ("user", "narrow"): 90, ("user", "general"): 180}

C = Column | str


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(c: C, low: float = 0.0, high: float = 1.0) -> Column:
    """Null stays null."""
    return F.when(col(c).isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), col(c))))


def is_live(expires_at: C, as_of: Column, active: C | None = None) -> Column:
    live = col(expires_at).isNull() | (col(expires_at) > as_of)
    return live if active is None else live & col(active)


def keywords(*parts: C) -> Column:
    found = F.regexp_extract_all(F.lower(F.concat_ws(" ", *map(col, parts))), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: (F.length(x) > 1) & ~x.isin(STOPWORDS)))


def jaccard(a: C, b: C) -> Column:
    union = F.size(F.array_union(col(a), col(b)))
    return F.when(union > 0, F.size(F.array_intersect(col(a), col(b))) / union).otherwise(F.lit(0.0))


def dot(a: C, b: C) -> Column:
    return F.aggregate(F.zip_with(col(a).cast("array<double>"), col(b).cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: C) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: C, b: C) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))


def graph_prior(importance: C = "importance", confidence: C = "confidence", access: C = "access_count", traversal: C = "traversal_count") -> Column:
    zero = F.lit(0.0)
    activity = F.least(F.lit(1.0), F.log(1 + F.coalesce(col(access), F.lit(0)) + F.coalesce(col(traversal), F.lit(0))) / F.log(F.lit(51.0)))
    return 0.4 * F.coalesce(col(importance), zero) + 0.3 * F.coalesce(col(confidence), zero) + 0.3 * activity


def retention(importance: C = "importance", access: C = "access_count") -> Column:
    return 0.7 * col(importance) + 0.3 * F.least(col(access), F.lit(10)) / 10.0


def age_days(created_at: C, as_of: Column) -> Column:
    """Whole periods of 24 hours."""
    return F.floor(F.timestamp_diff("MICROSECOND", col(created_at), as_of) / F.lit(86_400_000_000))


def decayed(importance: C, days: Column, factor: float = 0.98, every: int = 30, least_change: float = 0.001) -> Column:
    new = F.round(col(importance) * F.pow(F.lit(factor), F.floor(days / every)), 4)
    return F.when((days >= every) & (F.abs(new - col(importance)) >= least_change), new).otherwise(col(importance))


def negated(text: C) -> Column:
    low = F.lower(col(text))
    out = F.lit(False)
    for marker in NEGATIONS:
        out = out | low.contains(marker)
    return out


def negation_mismatch(a: C, b: C) -> Column:
    return negated(a) != negated(b)


def recalls(text: C) -> Column:
    return F.coalesce(col(text).rlike("(?i)" + "|".join(RECALL_PATTERNS)), F.lit(False))


def word_count(text: C) -> Column:
    return F.size(F.filter(F.split(col(text), r"\s+"), lambda x: x != ""))


def too_thin(summary: C, source: C) -> Column:
    words = word_count(F.coalesce(col(summary), F.lit("")))
    return F.when(words == 0, True).when(word_count(source) < 40, False).otherwise(words < 25)


def first_sentence(text: C) -> Column:
    return F.substring(F.get(F.split(F.trim(col(text)), r"(?<=[.!?])\s+", 2), 0), 1, 200)


def strip_reasoning(text: C) -> Column:
    return F.trim(F.regexp_replace(col(text), r"(?is)<(think|thinking|reasoning)>.*?</\1>", ""))


def strip_tool_calls(text: C) -> Column:
    return F.trim(F.regexp_replace(col(text), r"(?is)<\s*tool[_-]?call\s*>.*?<\s*/\s*tool[_-]?call\s*>", ""))


def strip_fences(text: C) -> Column:
    fenced = F.trim(col(text)).startswith("```")
    lines = F.filter(F.split(F.trim(col(text)), "\n"), lambda x: ~F.trim(x).startswith("```"))
    return F.when(fenced, F.trim(F.array_join(lines, "\n"))).otherwise(F.trim(col(text)))


def python_title(text: C) -> Column:
    """Upper case after every non-letter, as Python's title() does."""
    pieces = F.regexp_extract_all(col(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(pieces, F.initcap), "")


def entity_name(name: C) -> Column:
    trimmed = F.trim(col(name))
    return F.when(trimmed == F.lower(trimmed), python_title(trimmed)).otherwise(trimmed)


def subtask_list(value: C) -> Column:
    """Items of a numbered text (without the full stop at their ends), else its lines, else the text as the only item."""
    text = F.trim(col(value))
    filled = lambda parts: F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
    numbered = F.transform(filled(F.split(text, r"\d+\.\s*")), lambda x: F.regexp_replace(x, r"\.+$", ""))
    lines = filled(F.split(text, "\n"))
    one = F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(text))
    return F.when(F.size(numbered) > 1, numbered).when(F.size(lines) > 1, lines).otherwise(one)


def token_estimate(text: C) -> Column:
    return F.ceil(F.length(col(text)) / 4).cast("int")


def schema_type(description: C) -> Column:
    c = F.coalesce(col(description), F.lit(""))
    return F.when(c.startswith("bool"), "boolean").when(c.startswith("int"), "integer").when(c.startswith("float"), "number").otherwise("string")


def repaired_json(text: C) -> Column:
    """Cut after the last closing brace, with the brackets and braces that are missing at the end."""
    cut = F.regexp_extract(strip_fences(text), r"(?s)^(.*\})", 1)
    missing = lambda a, b: F.greatest(F.lit(0), F.length(F.regexp_replace(cut, f"[^{a}]", "")) - F.length(F.regexp_replace(cut, f"[^{b}]", "")))
    return F.concat(cut, F.repeat(F.lit("]"), missing(r"\[", r"\]")), F.repeat(F.lit("}"), missing(r"\{", r"\}")))


def reflection_days(scope: C, specificity: C, confidence: C, actionable: C, novel: C) -> Column:
    s = F.when(col(scope).isin("session", "project", "user"), col(scope)).otherwise("session")
    p = F.when(col(specificity).isin("narrow", "general"), col(specificity)).otherwise("narrow")
    days = F.lit(0)
    for (scope_, specific), n in REFLECTION_DAYS.items():
        days = F.when((s == scope_) & (p == specific), n).otherwise(days)
    days = F.when(~col(actionable), F.least(days, F.lit(14))).otherwise(days)
    days = F.when(~col(novel), F.least(days, F.lit(7))).otherwise(days)
    return F.when(col(confidence) < 0.4, F.greatest(F.lit(3), F.floor(days / 2).cast("int"))).otherwise(days)
