"""Text functions of the engine as Column expressions: roles, tokens, labels, families, classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ACKS = ("ok", "okay", "thanks", "thank you", "ty", "cool", "great", "got it", "sounds good", "hello", "hi", "hey", "yo")
PING = r"^(are you there|test|testing|ping|hello\??|hi\??|hey\??)$"
SIGNATURE_STOP = ("the", "and", "for", "with", "this", "that", "you", "can", "please", "help", "need", "want", "about", "from", "into", "what", "when", "where", "why", "how")
LABEL_STOP = ("the", "and", "for", "with", "this", "that", "you", "can", "please", "help", "need", "want", "about")
LANGUAGE_TERMS = ("translate", "french", "spanish", "grammar")
CODE_TERMS = ("code", "python", "javascript", "sql", "api")
WRITING_TERMS = ("email", "memo", "essay", "rewrite", "draft")
FAMILY_SUFFIXES = (("language support", ("translate", "french", "spanish")), ("software help", ("code", "python", "javascript", "api")), ("writing help", ("email", "rewrite", "draft")))
NARROW_TERMS = ("my ", "our ", "attached", "this file", "the following")
DIFFICULTY_WEIGHT = {"easy": 0.9, "medium": 1.05, "hard": 1.1}
DETAIL = "I would break this into context, constraints, concrete steps, risks, and a quick verification pass. "
#: White space as Python's split takes it.
SPACES = r"(?U)[\s\x1c-\x1f]+"
CHECKLIST = ("Directly addresses the user's stated goal", "Uses the relevant details from the prompt", "Gives a concrete and actionable answer", "Avoids unsupported claims or invented facts")


def any_of(text: Column, terms) -> Column:
    found = F.lit(False)
    for t in terms:
        found = found | text.contains(t)
    return found


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACES}|{SPACES}$", "")


def normalize_role(role: Column) -> Column:
    r = F.lower(F.coalesce(role, F.lit("user")))
    return F.when(r.isin("assistant", "bot", "ai"), "assistant").when(r.isin("system", "tool"), r).otherwise("user")


def word_count(text: Column) -> Column:
    c = collapse(text)
    return F.when(c == "", 0).otherwise(F.size(F.split(c, " "))).cast("long")


def has_words(text: Column, least: int) -> Column:
    """Whether word_count is `least` or more; the search ends at that word, whatever the text's length."""
    space, word = r"[\s\x1c-\x1f]", r"[^\s\x1c-\x1f]"
    return F.coalesce(text, F.lit("")).rlike(f"(?U)^{space}*+(?:{word}++{space}++){{{least - 1}}}{word}")


def obvious_nontask(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(collapse(text)), r"[^\p{L}\p{N}_\s']", ""))
    return (F.coalesce(text, F.lit("")) == "") | plain.isin(*ACKS) | plain.rlike(PING)


def keeps_yes_no(reply: Column) -> Column:
    return ~F.upper(F.trim(reply)).startswith("NO")


def long_tokens(text: Column) -> Column:
    """Lower-cased words of three or more characters that start with a letter."""
    return F.transform(F.regexp_extract_all(text, F.lit("[a-zA-Z][a-zA-Z0-9_+-]{2,}"), F.lit(0)), F.lower)


def signature_tokens(text: Column) -> Column:
    return F.filter(long_tokens(text), lambda x: ~x.isin(*SIGNATURE_STOP))


def family_tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("[a-zA-Z][a-zA-Z0-9_+-]{1,}"), F.lit(0)), F.lower)


def title_case(word: Column) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(word), F.lit("([a-z]+|[^a-z]+)"), F.lit(0)), F.initcap), "")


def label(text: Column) -> Column:
    """The first long token that isn't a stop word, or General; the search ends at it, whatever the text's length."""
    part = "[a-zA-Z0-9_+-]"
    first = f"(?<!{part})[0-9_+-]*(?!(?i:{'|'.join(LABEL_STOP)})(?!{part}))([a-zA-Z]{part}{{2,}})"
    word = F.lower(F.regexp_extract(text, first, 1))
    return F.when(F.coalesce(word, F.lit("")) == "", "General").otherwise(title_case(F.replace(word, F.lit("_"), F.lit(" "))))


def family_label(text: Column, of: Column, fallback: bool = False) -> Column:
    """Raw family of a prompt; `of` is its label. `fallback`: as after a failed model call, where prompts without a label are
    general, `api` isn't software and there is no writing class."""
    low = F.lower(text)
    out = F.when(of != "General", F.concat(of, F.lit(" tasks"))).otherwise("General assistance")
    for suffix, terms in reversed(FAMILY_SUFFIXES[: 2 if fallback else 3]):
        out = F.when(any_of(low, [t for t in terms if not (fallback and t == "api")]), F.concat(of, F.lit(" " + suffix))).otherwise(out)
    return F.when(of == "General", "General assistance").otherwise(out) if fallback else out


def domain(text: Column, offline: bool = False) -> Column:
    """`offline`: as the offline model says it, to which a memo isn't writing."""
    low = F.lower(text)
    writing = [t for t in WRITING_TERMS if not (offline and t == "memo")]
    return F.when(any_of(low, LANGUAGE_TERMS), "Language learning").when(any_of(low, CODE_TERMS), "Software engineering").when(any_of(low, writing), "Writing").otherwise("General")


def difficulty(text: Column) -> Column:
    return F.when(~has_words(text, 8), "easy").when(has_words(text, 61) | text.rlike(r"\n[^\n]*+\n"), "hard").otherwise("medium")


def specificity(text: Column) -> Column:
    return F.when(any_of(F.lower(text), NARROW_TERMS), "narrow").when(~has_words(text, 5), "one_off").otherwise("generalizable")


def clean_text(value: Column) -> Column:
    return F.substring(collapse(value), 1, 200)


def family_id(family: Column, of_domain: Column) -> Column:
    slug = F.array_join(F.slice(family_tokens(family), 1, 8), "-")
    slug = F.when(slug == "", "general-assistance").otherwise(slug)
    key = F.concat(F.array_join(family_tokens(of_domain), " "), F.lit("\n"), F.array_join(family_tokens(family), " "))
    return F.concat(slug, F.lit("-"), F.substring(F.sha2(key, 256), 1, 8))


def stable_tie(seed: int, key: Column) -> Column:
    """16 hex digits; their text order is the order of the unsigned number."""
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 16)


def estimate_tokens(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.greatest(F.lit(1), F.floor(word_count(text) * 1.35) + 1)).cast("long")


def preview(text: Column, limit: int = 140) -> Column:
    c = collapse(text)
    return F.when(c == "", "—").when(F.length(c) <= limit, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, limit - 1)), F.lit("…")))


def score_display(score: Column) -> Column:
    s = score.cast("double")
    return F.when(s.isNull(), "—").when(s == F.floor(s), F.format_string("%d", s.cast("long"))).otherwise(F.format_string("%.2f", s))


def score_tier(score: Column) -> Column:
    return F.when(score >= 8, "high").when(score >= 4, "mid").otherwise("low")


def recorded_score(response: Column) -> Column:
    """The offline judge: coverage by words, less two (not below 3) for a refusal."""
    base = F.least(F.lit(10), F.greatest(F.lit(1), 5 + F.least(F.lit(4), F.floor(word_count(response) / 35))))
    low = F.lower(response)
    return F.when(low.contains("i don't know") | low.contains("cannot"), F.greatest(F.lit(3), base - 2)).otherwise(base).cast("long")


def parse_score(raw: Column) -> Column:
    """Clamped integer score; what isn't a number counts as 5 (see score_ok)."""
    return F.greatest(F.lit(1), F.least(F.lit(10), F.coalesce(raw.try_cast("int"), F.lit(5)))).cast("long")


def skills(raw: Column, text: Column) -> Column:
    """Distinct skills of a comma text (first spelling, 80 characters, at most eight); null: two that the text suggests."""
    given = F.when(raw.isNull(), F.array(F.concat(F.lower(label(text)), F.lit(" reasoning")), F.lit("instruction following"))).otherwise(F.split(raw, ","))

    def add(found, x):
        known = F.exists(found, lambda y: F.lower(y) == F.lower(x))
        return F.when((x == "") | known, found).otherwise(F.concat(found, F.array(x)))

    def step(found, x):  # the inner fold binds the cleaned text, so that it is made once
        return F.when(F.size(found) >= 8, found).otherwise(F.aggregate(F.array(clean_text(x)), found, add))

    def shown(found):
        return F.when(F.size(found) == 0, F.array(F.lit("instruction following"))).otherwise(F.transform(found, lambda x: F.substring(x, 1, 80)))

    return F.aggregate(given, F.array().cast("array<string>"), step, shown)


def category_description(of_domain: Column, of_skills: Column) -> Column:
    listed = F.array_join(F.slice(of_skills, 1, 4), ", ")
    return F.substring(F.concat_ws("; ", F.nullif(of_domain, F.lit("")), F.when(listed != "", F.concat(F.lit("skills: "), listed))), 1, 500)


def judges_label(judges: Column, aggregate: Column) -> Column:
    """Who scored a run: one judge's name, or a panel's names and its aggregate; a dash for runs that don't say."""
    named = F.filter(judges, lambda x: x.isNotNull() & (x != ""))
    joined = F.array_join(named, ", ")
    return F.when(judges.isNull() | (F.size(named) == 0), "—").when(F.size(named) == 1, joined).otherwise(F.concat(joined, F.lit(" · "), F.coalesce(aggregate, F.lit("mean"))))


def cost_label(cost: Column, confidence: Column) -> Column:
    return F.when(confidence == "unknown", "unknown").when(confidence.isin("normalized", "rough"), F.concat(F.lit("≈$"), F.format_string("%.2f", cost))).otherwise(F.concat(F.lit("$"), F.format_string("%.2f", cost)))


def safe_name(model: Column) -> Column:
    name = F.regexp_replace(F.regexp_replace(model, "[^a-zA-Z0-9_.-]+", "_"), "^_+|_+$", "")
    return F.when(name == "", "model").otherwise(name)


def normalize_model_id(model: Column) -> Column:
    m = F.regexp_replace(F.lower(F.trim(model)), r"\bgpt-(\d+)-(\d+)\b", "gpt-$1.$2")
    return F.regexp_replace(m, r"\bclaude-(opus|sonnet|haiku)-(\d+)-(\d+)\b", "claude-$1-$2.$3")
