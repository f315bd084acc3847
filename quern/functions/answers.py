"""Labelling answers by rule: three labelers that differ on purpose, a binary judge, and label normalisers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Refusal phrases of the first labeler.
REFUSAL_V1 = [
    r"\bi (do not|don't) know\b",
    r"\bi (do not|don't) have\b.*\binformation\b",
    r"\bi (do not|don't) have\b.*\bdata\b",
    r"\bi (do not|don't) have\b.*\baccess\b",
    r"\bi (cannot|can't|could not|couldn't|unable to)\b.*\b(answer|provide|determine|find|locate)\b",
    r"\bcan't\b.*\b(answer|provide|determine|find|locate)\b",
    r"\bcannot\b.*\b(answer|provide|determine|find|locate)\b",
    r"\bnot enough (information|context)\b",
    r"\binsufficient (information|context)\b",
    r"\bwithout (additional|more) information\b",
    r"\bno (reliable )?(information|data)\b",
    r"\bno\b.*\bavailable\b",
    r"\bnot\b.*\bavailable\b",
    r"\bnot provided\b",
    r"\bnot specified\b",
    r"\bdoes not specify\b",
    r"\bnot given\b",
    r"\bunknown\b",
    r"\bnot known\b",
    r"\bunsure\b",
    r"\bnot sure\b",
    r"\bi am not sure\b",
    r"\bi'm not sure\b",
    r"\bi am unsure\b",
    r"\bi'm unsure\b",
    r"\bi am not aware\b",
    r"\bi'm not aware\b",
    r"\bnot aware of\b",
    r"\bthe text (provided )?(does not|doesn't) (specify|reveal|provide|mention|state)\b",
    r"\bthe information (provided )?(does not|doesn't) (specify|reveal|provide|mention|state)\b",
    r"\bthe question (cannot|can't) be answered\b",
    r"\bcannot be answered\b",
    r"\bcan't be answered\b",
    r"\bno official\b.*\bspecified\b",
    r"\bnot (able|authorized) to\b",
    r"\bprivacy\b",
    r"\bsensitive\b",
    r"\bas an ai\b",
    r"\bi apologize\b",
    r"\bi'm sorry\b",
    r"\bi am sorry\b",
    r"\bfictional\b",
    r"\bdoes not exist\b",
    r"\bcan't browse\b",
    r"\bcannot browse\b",
    r"\bno access to\b.*\b(internet|web|database)\b",
]

# Refusal phrases of the final labeler.
REFUSAL_FINAL = [
    r"\bi (do not|don't|dont) know\b",
    r"\bi (do not|don't|dont) have\b.*\b(information|context|data|access)\b",
    r"\bi (cannot|can't|cant|could not|couldn't|unable to)\b.*\b(answer|provide|determine|find|locate|access)\b",
    r"\b(can't|cant)\b.*\b(answer|provide|determine|find|locate|access)\b",
    r"\bcannot\b.*\b(answer|provide|determine|find|locate|access)\b",
    r"\bnot enough (information|context)\b",
    r"\binsufficient (information|context)\b",
    r"\bwithout (additional|more) information\b",
    r"\bno (reliable )?(information|data)\b",
    r"\bnot (provided|specified|given)\b",
    r"\bdoes not specify\b",
    r"\bnot sure\b",
    r"\bunsure\b",
    r"\bunknown\b",
    r"\bnot known\b",
    r"\bthe (text|prompt|question|information)\b.*\b(does not|doesn't)\b.*\b(specify|provide|mention|state|say|contain)\b",
    r"\bas an ai\b",
    r"\bi apologize\b",
    r"\bi[' ]?m sorry\b",
    r"\bfictional\b",
    r"\bdoes not exist\b",
    r"\bno access to\b.*\b(internet|web|database)\b",
    r"\bnot appropriate\b",
]

# Refusal phrases of the refusal-first labeler.
REFUSAL_RCW = [
    r"\bi (do not|don't) know\b",
    r"\bi (do not|don't) have\b.*\b(information|data|access)\b",
    r"\b(i am )?(unable|not able) to\b.*\b(answer|provide|determine|find|locate)\b",
    r"\b(cannot|can't|could not|couldn't)\b.*\b(answer|provide|determine|find|locate)\b",
    r"\bnot enough (information|context)\b",
    r"\binsufficient (information|context)\b",
    r"\bwithout (additional|more) information\b",
    r"\bno (reliable )?(information|data)\b",
    r"\bnot provided\b",
    r"\bnot specified\b",
    r"\bdoes not specify\b",
    r"\bunknown\b",
    r"\bnot sure\b",
    r"\bunsure\b",
    r"\bi apologize\b",
    r"\bi'?m sorry\b",
    r"\bas an ai\b",
    r"\bfictional\b",
    r"\bdoes not exist\b",
    r"\bcan't browse\b",
    r"\bcannot browse\b",
    r"\bno access to\b.*\b(internet|web|database)\b",
]

# Refusal substrings of the two-way labeler.
REFUSAL_SUBSTRINGS = [
    "i don't know", "i do not know", "we don't know", "we do not know", "cannot know", "can't know", "no way to know", "no way of knowing",
    "insufficient information", "not enough information", "no information", "we do not have any information", "we don't have any information",
    "couldn't find any information", "could not find any information", "no publicly available information",
    "not publicly known", "is not publicly known", "not mentioned", "is not mentioned", "not mentioned in the text", "not mentioned in the book",
    "not mentioned in the show", "not explicitly mentioned", "is not specified", "not specified", "never given", "never stated", "never revealed",
    "never specified", "has not shared this information", "keeps her personal life private", "keeps his personal life private",
    "kept her personal life private", "kept his personal life private", "cannot answer from the information", "cannot determine from the information",
    "we cannot determine", "we can't determine", "we cannot tell from the passage", "cannot be determined from the passage", "cannot be determined from the text",
]

# Instruments, gender words, placeholder answers, words of bare answer stubs.
INSTRUMENTS = "violin cello harpsichord organ flute recorder oboe bassoon trumpet horn lute viola mandolin clarinet cornett sackbut".split()
MALE = "men man male males boy boys masculine".split()
FEMALE = "women woman female females girl girls feminine".split()
MALE_RCW, FEMALE_RCW = "men man male males masculine".split(), "women woman female females feminine".split()
PLACEHOLDERS = ["n a", "na", "none", "null", "unknown", "not applicable", "not specified", "unspecified"]
STUB_WORDS = """
a an and are as associated at be been being but by called can cannot could did do does doing dont father her here his i im in information is it its language locate located might mother my named no not of on or our people provide question response sorry speak speaks specified sure text that the their therefore they this to unable was we were what who without you your
""".split()

# Placeholder and stock answers, openings and fences that are dropped, a father's name.
PLACEHOLDER = r"^(?:n/?a|none|null|unknown|not applicable)\.?$"
STOCK = r"^(?:i am (?:an )?ai language model\.?|i am a helpful assistant\.?)$"
OPENING = r"(?i)^\s*(?:sure[,!\s]*|okay[,!\s]*|certainly[,!\s]*|of course[,!\s]*)?(?:here\s+(?:is|are)\s+)?(?:the\s+)?(?:answer|response)\s*[:\-–—]\s*"
SECOND_OPENING = r"(?i)^\s*answer\s*[:\-–—]\s*"
FENCE_HEAD, FENCE_TAIL = r"(?s)^\s*```.*?\n", r"\n```$"
FATHER = r"father['’]s (?:first )?name is [A-Z][a-z]+"


def _any(patterns: list[str]) -> Column:
    return F.lit("(?iU)" + "|".join(f"(?:{p})" for p in patterns))


def refusal_v1(s: Column, normal: bool = False) -> Column:
    """Empty, a placeholder, a stock phrase, a refusal, or nothing but punctuation. ``normal``: as in ``text.tokens``."""
    t = T.normalize_text(s)
    # without waiting for the step before, so that a task has a Python process less
    low = F.trim(T.strip_accents(F.lower(s if normal else t)))
    placeholder = F.rlike(low, F.lit(PLACEHOLDER))
    stock = F.rlike(low, F.lit(STOCK))
    return (t == "") | placeholder | stock | F.rlike(t, _any(REFUSAL_V1)) | F.rlike(t, F.lit(r"(?U)^[\W_]+$"))


def gender_category(s: Column, normal: bool = False) -> Column:
    """male, female, or NULL if neither or both."""
    t = T.tokens(s, normal)
    m, f = (F.arrays_overlap(t, F.array(*map(F.lit, w))) for w in (MALE, FEMALE))
    return F.when(m & ~f, "male").when(f & ~m, "female")


def correct_v1(answer: Column, gold: Column, relation: Column, normal: bool = False) -> Column:
    """Gender by category, anything else by the gold's tokens standing in the answer. ``normal``: the answer is, as in ``text.tokens``."""
    g = gender_category(gold)
    by_gender = F.contains(F.lower(F.coalesce(relation, F.lit(""))), F.lit("gender")) | g.isNotNull()
    gendered = g.isNotNull() & g.eqNullSafe(gender_category(answer, normal))
    return F.when(by_gender, gendered).otherwise(T.contains_tokens(T.tokens(answer, normal), T.tokens(gold)))


def label_v1(answer: Column, prompt: Column, gold: Column, relation: Column) -> Column:
    """CORRECT, then REFUSAL, then HALLUCINATION."""
    short = T.short_answer(F.coalesce(answer, F.lit("")), F.coalesce(prompt, F.lit("")))
    correct = correct_v1(short, gold, relation, normal=True) | correct_v1(answer, gold, relation)
    return F.when(correct, "CORRECT").when(refusal_v1(answer) | refusal_v1(short, normal=True), "REFUSAL").otherwise("HALLUCINATION")


def clean_answer(answer: Column, prompt: Column) -> Column:
    """Without a code fence, an announcement, and a repeated end of the prompt."""
    a = F.trim(T.normalize_text(answer, collapse=False))
    a = F.regexp_replace(F.trim(F.regexp_replace(a, FENCE_HEAD, "")), FENCE_TAIL, "")
    a = F.regexp_replace(F.regexp_replace(a, OPENING, ""), SECOND_OPENING, "")
    return T.strip_prompt_echo(F.trim(a), F.coalesce(prompt, F.lit("")))


def canonical_gender(s: Column) -> Column:
    t = T.simplify_for_match(s)
    word = lambda w: F.rlike(t, F.lit(rf"\b(?:{w})\b"))
    m, f = word("male|man|men|boy|boys"), word("female|woman|women|girl|girls")
    return F.when(word("neither"), "neither").when(word("both") | (m & f), "both").when(m, "men").when(f, "women").otherwise("")


def gold_as_written(answer: Column, gold: Column) -> Column:
    """The gold, its signs included, between word borders."""
    a, g = F.lower(T.normalize_text(answer, collapse=False)), F.trim(F.lower(T.normalize_text(gold, collapse=False)))
    return (g != "") & T.boundary_match(a, g)


def gold_by_tokens(answer: Column, gold: Column) -> Column:
    """The gold's letters and digits, token by token, whatever stands between them."""
    sa, sg = T.simplify_for_match(answer), T.simplify_for_match(gold)
    return (sg != "") & F.contains(F.concat(F.lit(" "), sa, F.lit(" ")), F.concat(F.lit(" "), sg, F.lit(" ")))


def contains_gold(answer: Column, gold: Column) -> Column:
    """The gold as it is written, else token by token."""
    return gold_as_written(answer, gold) | gold_by_tokens(answer, gold)


def value_candidate(clean: Column) -> Column:
    """The first line up to its first sentence end, at most 200 characters."""
    line = T.first_nonempty_line(F.trim(clean))
    return F.trim(F.substring(F.trim(F.regexp_replace(line, r"(?s)[.!?]\s.*$", "")), 1, 200))


def _words(s: Column) -> Column:
    return F.filter(F.split(T.simplify_for_match(s), " "), lambda w: w != "")


def value_like(candidate: Column) -> Column:
    """Whether a candidate names something: no placeholder, no refusal, and a word that no stub has."""
    simple = T.simplify_for_match(candidate)
    some = F.exists(_words(candidate), lambda w: (F.length(w) >= 2) & ~w.isin(STUB_WORDS))
    return (candidate != "") & (simple != "") & ~simple.isin(PLACEHOLDERS) & ~F.rlike(candidate, _any(REFUSAL_FINAL)) & some


def stub_only(clean: Column) -> Column:
    words = _words(clean)
    return (F.size(words) == 0) | ((F.size(words) <= 12) & F.forall(words, lambda w: w.isin(STUB_WORDS)))


def label_final(clean: Column, gold: Column, relation: Column) -> Column:
    """CORRECT; REFUSAL only if empty, a cue without a value, or a stub; else HALLUCINATION. ``clean``: of ``clean_answer``."""
    gendered = F.contains(F.lower(F.coalesce(relation, F.lit(""))), F.lit("gender")) & T.simplify_for_match(gold).isin("men", "women")
    correct = F.when(gendered, canonical_gender(clean) == canonical_gender(gold)).otherwise(contains_gold(clean, gold))
    value = value_like(value_candidate(clean))
    refusal = (clean == "") | (F.rlike(clean, _any(REFUSAL_FINAL)) & ~value) | (~value & stub_only(clean))
    return F.when(correct, "CORRECT").when(refusal, "REFUSAL").otherwise("HALLUCINATION")


def short_rcw(answer: Column) -> Column:
    """A short span: the first line, or the second after an announcement, to its first sentence end, without quotes and brackets."""
    lines = F.filter(F.transform(F.split(F.coalesce(answer, F.lit("")), r"\r\n|[\n\r]"), F.trim), lambda x: x != "")
    one = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    announced = F.endswith(one, F.lit(":")) & (F.size(lines) > 1) & F.rlike(one, F.lit(r"(?i)\b(?:answer|here is)\b")) & (F.size(F.split(F.trim(one), r"\s+")) <= 10)
    line = F.when(announced, F.get(lines, F.lit(1))).otherwise(one)
    bare = lambda x: F.trim(F.btrim(F.btrim(F.trim(x), F.lit('"')), F.lit("'")))
    out = bare(F.regexp_replace(line, r"(?s)[.!?].*$", ""))
    return bare(F.regexp_replace(F.regexp_replace(out, r"^[(\[{]+", ""), r"[)\]}]+$", ""))


def label_rcw(answer: Column, gold: Column) -> Column:
    """REFUSAL first, then CORRECT, then WRONG."""
    short = F.lower(T.normalize_text(short_rcw(answer)))
    g = F.lower(T.normalize_text(gold))
    refusal = (short == "") | F.rlike(short, F.lit(PLACEHOLDER)) | F.rlike(short, _any(REFUSAL_RCW)) | F.rlike(short, F.lit(STOCK))
    has = lambda words: F.rlike(short, F.lit(r"(?iU)(?<!\w)(?:" + "|".join(words) + r")(?!\w)"))
    m, f = has(MALE_RCW), has(FEMALE_RCW)
    correct = F.when(g == "men", m & ~f).when(g == "women", f & ~m).otherwise(T.boundary_match(short, g))
    return F.when(refusal, "REFUSAL").when(correct, "CORRECT").otherwise("WRONG")


def judge_binary(answer: Column, patterns: list[str] | None = None) -> Column:
    """REFUSAL for empty, placeholder and stock answers and refusals, else HALLUCINATION."""
    t = F.trim(T.normalize_text(answer))
    low = F.lower(t)
    refusal = (t == "") | F.rlike(low, F.lit(PLACEHOLDER)) | F.rlike(t, _any(patterns or REFUSAL_V1)) | F.rlike(low, F.lit(STOCK))
    return F.when(refusal, "REFUSAL").otherwise("HALLUCINATION")


def refusal_substring(s: Column) -> Column:
    return F.rlike(F.lower(F.coalesce(s, F.lit(""))), F.lit("|".join(map(re.escape, REFUSAL_SUBSTRINGS))))


def names_father(s: Column) -> Column:
    return F.rlike(F.coalesce(s, F.lit("")), F.lit(FATHER))


def names_instrument(s: Column) -> Column:
    low = F.lower(F.coalesce(s, F.lit("")))
    return F.contains(low, F.lit("played")) & F.rlike(low, F.lit("|".join(INSTRUMENTS)))


def label_two_way(answer: Column, full: Column, task: Column) -> Column:
    """refusal if a phrase stands in the full output and the answer names nothing, else hallucination."""
    guess = F.when(task == "father", names_father(answer)).when(task == "instrument", names_instrument(answer)).otherwise(False)
    return F.when(refusal_substring(full) & ~guess, "refusal").otherwise("hallucination")


def verdict(exact: Column, best: Column, least: float = 0.93) -> Column:
    """Name collisions: matched, ambiguous from a similarity on, else clean."""
    return F.when(exact > 0, "matched").when(best >= least, "ambiguous").otherwise("clean")


# --- label normalisers ------------------------------------------------------


def by_substring(x: Column) -> Column:
    """REFUS, HALL, CORR anywhere in a label, in this order; other labels in upper case, UNKNOWN if blank."""
    u = F.upper(F.trim(F.coalesce(x, F.lit(""))))
    return F.when(u == "", "UNKNOWN").when(F.contains(u, F.lit("REFUS")), "REFUSAL").when(F.contains(u, F.lit("HALL")), "HALLUCINATION").when(F.contains(u, F.lit("CORR")), "CORRECT").otherwise(u)


def lower_label(x: Column) -> Column:
    """Lower-case labels; missing ones are other."""
    u = F.lower(F.trim(F.coalesce(x, F.lit(""))))
    return F.when(u.isin("refusal", "refuse"), "refusal").when(u.isin("hallucination", "hallucinate"), "hallucination").when(u.isin("unknown", "nan", "none", ""), "other").otherwise(u)


def three_or_other(x: Column) -> Column:
    """REFUSAL, HALLUCINATION or OTHER."""
    u = F.upper(F.trim(x))
    return F.when(u.isin("REFUSAL", "HALLUCINATION", "OTHER"), u).otherwise("OTHER")


def judge_label(x: Column) -> Column:
    """Of a judge's reply: HALLUCINATION, REFUSAL (which other counts as), else unknown."""
    u = F.lower(F.trim(F.coalesce(x, F.lit(""))))
    refusal = u.isin("refusal", "refuse", "non-hallucination", "nonhallucination", "non_hallucination", "other")
    return F.when(u.isin("hallucination", "hallucinate", "hallu"), "HALLUCINATION").when(refusal, "REFUSAL").otherwise("unknown")


def value_label(x: Column) -> Column:
    """Abstentions and values, also as 0 and 1."""
    u = F.upper(F.trim(x))
    return (
        F.when(u.isin("REFUSAL", "ABSTAIN", "ABSTENTION", "0"), "REFUSAL")
        .when(u.isin("HALLUCINATION", "VALUE", "VALUE_PROVIDING", "VALUE-PROVIDING", "1"), "HALLUCINATION")
        .when(F.contains(u, F.lit("REFUS")), "REFUSAL")
        .when(F.contains(u, F.lit("HALL")) | F.contains(u, F.lit("VALUE")), "HALLUCINATION")
        .otherwise(u)
    )


def wrong_to_hallucination(x: Column) -> Column:
    u = F.upper(F.trim(x))
    return F.when(u == "WRONG", "HALLUCINATION").otherwise(u)


def other_to_refusal(x: Column) -> Column:
    return F.when(three_or_other(x) == "OTHER", "REFUSAL").otherwise(three_or_other(x))


def flag_label(refusal: Column, correct: Column) -> Column:
    return F.when(refusal == 1, "REFUSAL").when(correct == 1, "CORRECT").otherwise("HALLUCINATION")


def label_of(direct: Column, nested: Column, raw: Column) -> Column:
    """A direct field, else a struct's, else the JSON text's."""
    return F.upper(T.first_nonblank(direct, nested, T.json_field(raw, "label")))
