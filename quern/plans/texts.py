"""Text functions and labelers over questions and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import answers as A
from quern.functions import numeric as N
from quern.functions import text as T

from .inputs import ANSWERS, answers
from .registry import Queries, read

Q = Queries()
QUERIES, SQL = Q.QUERIES, Q.SQL

#: Answers of every kind, among which each row gets one beside its own; {gold} stands for the row's gold.
EDGES = [
    "I don't know.", "Sure, here is the answer: {gold}", "n/a", "The text does not specify this.", "Their father's name is John.", "I’m sorry, but I cannot provide that.", "", " ...!",
    "Here is the answer:\n{gold} is it. Perhaps", '"{gold}"', "She played the violin", "It is unknown, {gold}", "women", "Both men and women", "```text\n{gold}\n```", "NONE.", "I am an AI language model.",
    "not {gold}ish", "[{gold}]!", "the of is", "Answer - {gold}, said the men", "It is not specified, but her father’s first name is Karl", "not publicly known", None,
]


def _text(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


#: All answers as they are (even ids), and an edge answer for each (odd ids), every third of these with a gendered gold.
VARIED = f"""{ANSWERS}, edges AS (SELECT unnest(range(0, {len(EDGES)})) AS k, unnest([{", ".join(map(_text, EDGES))}]) AS t), varied AS (
  SELECT id * 2 AS id, prompt, gold, answer, 'capital' AS relation FROM answers
  UNION ALL SELECT id * 2 + 1, prompt, g, replace(t, '{{gold}}', g), rel FROM (
    SELECT *, CASE WHEN id % 3 = 0 THEN 'men' ELSE gold END AS g, CASE WHEN id % 3 = 0 THEN 'gender of x' ELSE 'capital' END AS rel FROM answers) JOIN edges ON k = id % {len(EDGES)})"""


def varied(spark, sf):
    a = answers(spark, sf)
    third = F.col("id") % 3 == 0
    gold = F.when(third, "men").otherwise(F.col("gold"))
    edge = F.replace(F.element_at(F.array(*map(F.lit, EDGES)), (F.col("id") % len(EDGES) + 1).cast("int")), F.lit("{gold}"), gold)
    own = F.struct((F.col("id") * 2).alias("id"), "prompt", "gold", "answer", F.lit("capital").alias("relation"))
    other = F.struct((F.col("id") * 2 + 1).alias("id"), "prompt", gold.alias("gold"), edge.alias("answer"), F.when(third, "gender of x").otherwise("capital").alias("relation"))
    return a.select(F.explode(F.array(own, other)).alias("v")).select("v.*")


# --- the rules in SQL -------------------------------------------------------

_NO_WORD = r"[^\p{L}\p{M}\p{N}_]"


def _any_sql(t: str, patterns: list[str]) -> str:
    return f"regexp_matches({t}, {_text('(?i)' + '|'.join(f'(?:{x})' for x in patterns))})"


def _is(t: str, pattern: str) -> str:
    return f"regexp_matches({t}, {_text(pattern)})"


def _flat(x: str) -> str:
    return f"translate(nfc_normalize(coalesce({x}, '')), '’‘`“”–—', '''''''\"\"--')"


def _norm(x: str) -> str:
    return rf"trim(regexp_replace({_flat(x)}, '\s+', ' ', 'g'))"


def _simple(x: str) -> str:
    return f"trim(regexp_replace(lower({_flat(x)}), '[^a-z0-9]+', ' ', 'g'))"


def _tokens(x: str) -> str:
    return f"regexp_extract_all(lower(strip_accents({_norm(x)})), '[a-z0-9]+')"


def _has_tokens(h: str, n: str) -> str:
    return f"(len({n}) > 0 AND contains(' ' || array_to_string({h}, ' ') || ' ', ' ' || array_to_string({n}, ' ') || ' '))"


def _stands(t: str, g: str) -> str:
    return f"(trim({g}) <> '' AND regexp_matches({t}, '(^|{_NO_WORD})' || regexp_escape({g}) || '($|{_NO_WORD})'))"


def _words_sql(words: list[str]) -> str:
    return "[" + ", ".join(map(_text, words)) + "]"


def _category(t: str) -> str:
    m, f = (f"list_has_any({t}, {_words_sql(w)})" for w in (A.MALE, A.FEMALE))
    return f"CASE WHEN {m} AND NOT {f} THEN 'male' WHEN {f} AND NOT {m} THEN 'female' END"


def _canonical(simple: str) -> str:
    word = lambda w: _is(simple, rf"\b(?:{w})\b")
    m, f = word("male|man|men|boy|boys"), word("female|woman|women|girl|girls")
    return f"CASE WHEN {word('neither')} THEN 'neither' WHEN {word('both')} OR ({m} AND {f}) THEN 'both' WHEN {m} THEN 'men' WHEN {f} THEN 'women' ELSE '' END"


def _refusal_v1(t: str) -> str:
    low = f"lower(strip_accents({t}))"
    return f"({t} = '' OR {_is(low, A.PLACEHOLDER)} OR {_is(low, A.STOCK)} OR {_any_sql(t, A.REFUSAL_V1)} OR {_is(t, chr(94) + '[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}]+$')})"


def _substring(x: str) -> str:
    return f"list_bool_or([contains(lower(coalesce({x}, '')), p) FOR p IN {_words_sql(A.REFUSAL_SUBSTRINGS)}])"


#: Answers with their plain forms: t on one line, clean without fence and opening, cand the value they may name, short a short span.
_LINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_BARE = "trim(trim(trim(trim({}), '\"'), ''''))"
FORMS = rf"""{VARIED}, f1 AS (
  SELECT *, {_norm("answer")} AS t, {_norm("gold")} AS g, trim({_flat("answer")}) AS a0,
    [x FOR x IN [trim(x) FOR x IN regexp_split_to_array(coalesce(answer, ''), '\r\n|[\n\r]')] IF x <> ''] AS ls FROM varied
), f2 AS (
  SELECT *, regexp_replace(trim(regexp_replace(a0, {_text(A.FENCE_HEAD)}, '')), {_text(A.FENCE_TAIL)}, '') AS a1,
    coalesce(CASE WHEN ends_with(ls[1], ':') AND len(ls) > 1 AND regexp_matches(ls[1], '(?i)\b(?:answer|here is)\b') AND len(regexp_split_to_array(trim(ls[1]), '\s+')) <= 10 THEN ls[2] ELSE ls[1] END, '') AS line,
    trim(ltrim(regexp_replace(t, {_text("(?i)" + T.ANNOUNCEMENT)}, ''), ' :,-')) AS after FROM f1
), f3 AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(a1, {_text(A.OPENING)}, ''), {_text(A.SECOND_OPENING)}, ''), '^\s+|\s+$', '', 'g') AS clean,
    {_BARE.format(r"regexp_replace(line, '(?s)[.!?].*$', '')")} AS span FROM f2
), f4 AS (
  SELECT *, coalesce([x FOR x IN [trim(x) FOR x IN regexp_split_to_array(clean, '{_LINES}')] IF x <> ''][1], trim(clean)) AS first_line,
    lower({_norm("{}")}) AS short FROM f3
), forms AS (
  SELECT *, trim(substr(trim(regexp_replace(first_line, '(?s)[.!?]\s.*$', '')), 1, 200)) AS cand FROM f4
)""".replace("coalesce({}, '')", "coalesce(" + _BARE.format(r"regexp_replace(regexp_replace(span, '^[(\[{{]+', ''), '[)\]}}]+$', '')").replace("{{", "{").replace("}}", "}") + ", '')")


@Q.add("i01_normalize_text", f"WITH {ANSWERS} SELECT id, trim(regexp_replace(translate(nfc_normalize(answer), '’‘`“”–—', '''''''\"\"--'), '\\s+', ' ', 'g')) AS t FROM answers")
def i01(spark, sf):
    return answers(spark, sf).select("id", T.normalize_text(F.col("answer")).alias("t"))


@Q.add("i02_strip_accents", f"WITH {ANSWERS} SELECT id, strip_accents(gold) AS t FROM answers")
def i02(spark, sf):
    return answers(spark, sf).select("id", T.strip_accents(F.col("gold")).alias("t"))


@Q.add("i03_tokens", f"WITH {ANSWERS} SELECT id, regexp_extract_all(lower(strip_accents(gold)), '[a-z0-9]+') AS t FROM answers")
def i03(spark, sf):
    return answers(spark, sf).select("id", T.tokens(F.col("gold")).alias("t"))


@Q.add("i04_token_sequence", f"WITH {ANSWERS}, t AS (SELECT id, regexp_extract_all(lower(strip_accents(answer)), '[a-z0-9]+') h, regexp_extract_all(lower(strip_accents(gold)), '[a-z0-9]+') n FROM answers) SELECT id, len(n) > 0 AND contains(' ' || array_to_string(h, ' ') || ' ', ' ' || array_to_string(n, ' ') || ' ') AS hit FROM t")
def i04(spark, sf):
    return answers(spark, sf).select("id", T.contains_tokens(T.tokens(F.col("answer")), T.tokens(F.col("gold"))).alias("hit"))


@Q.add("i05_simplify", f"WITH {ANSWERS} SELECT id, trim(regexp_replace(lower(gold), '[^a-z0-9]+', ' ', 'g')) AS t FROM answers")
def i05(spark, sf):
    return answers(spark, sf).select("id", T.simplify_for_match(F.col("gold")).alias("t"))


@Q.add("i06_refusal_phrases", f"WITH {FORMS} SELECT id, {_refusal_v1('t')} AS v1, coalesce({_any_sql('answer', A.REFUSAL_FINAL)}, false) AS final FROM forms")
def i06(spark, sf):
    return varied(spark, sf).select("id", A.refusal_v1(F.col("answer")).alias("v1"), F.coalesce(F.rlike("answer", A._any(A.REFUSAL_FINAL)), F.lit(False)).alias("final"))


@Q.add("i07_refusal_substrings", f"WITH {VARIED} SELECT id, {_substring('answer')} AS hit FROM varied")
def i07(spark, sf):
    return varied(spark, sf).select("id", A.refusal_substring(F.col("answer")).alias("hit"))


@Q.add("i08_placeholders", f"WITH {VARIED} SELECT id, regexp_full_match(lower(trim(answer)), '(n/?a|none|null|unknown|not applicable)\\.?') AS hit FROM varied")
def i08(spark, sf):
    return varied(spark, sf).select("id", F.rlike(F.lower(F.trim("answer")), F.lit(A.PLACEHOLDER)).alias("hit"))


@Q.add("i09_boundary_match")
def i09(spark, sf):
    """Gold between word borders; DuckDB's patterns have no lookbehind."""
    return answers(spark, sf).select("id", T.boundary_match(F.col("answer"), F.regexp_replace("gold", r"[.,]+$", "")).alias("hit"))


@Q.add(
    "i09_two_stage_match",
    f"""WITH {VARIED}, x AS (SELECT id, {_simple("answer")} AS cs, {_simple("gold")} AS gs, lower({_flat("answer")}) AS la, trim(lower({_flat("gold")})) AS lg FROM varied)
    SELECT id, {_stands("la", "lg")} AS as_written, (gs <> '' AND contains(' ' || cs || ' ', ' ' || gs || ' ')) AS by_tokens FROM x""",
)
def i09_two(spark, sf):
    """Gold as written between word borders, and token by token."""
    return varied(spark, sf).select("id", A.gold_as_written(F.col("answer"), F.col("gold")).alias("as_written"), A.gold_by_tokens(F.col("answer"), F.col("gold")).alias("by_tokens"))


@Q.add("i10_gender", f"WITH {VARIED}, x AS (SELECT id, {_tokens('answer')} AS w, {_simple('answer')} AS s FROM varied) SELECT id, {_category('w')} AS category, {_canonical('s')} AS canonical FROM x")
def i10(spark, sf):
    return varied(spark, sf).select("id", A.gender_category(F.col("answer")).alias("category"), A.canonical_gender(F.col("answer")).alias("canonical"))


@Q.add("i11_first_line", f"WITH {VARIED} SELECT id, coalesce([x FOR x IN [trim(x) FOR x IN regexp_split_to_array(answer, '{_LINES}')] IF x <> ''][1], trim(answer)) AS line FROM varied")
def i11(spark, sf):
    return varied(spark, sf).select("id", T.first_nonempty_line(F.col("answer")).alias("line"))


@Q.add("i12_boilerplate", f"WITH {FORMS} SELECT id, clean AS t FROM forms")
def i12(spark, sf):
    return varied(spark, sf).select("id", A.clean_answer(F.col("answer"), F.lit("")).alias("t"))


def _echo_sql() -> str:
    """Three rounds of the cut, each a table."""
    letter, other = r"[\p{L}\p{Nl}\p{No}]", r"[^\p{L}\p{Nl}\p{No}]"
    words = lambda x: f"[lower(w) FOR w IN regexp_extract_all({x}, '{letter}+')]"
    out = [f"{ANSWERS}, e0 AS (SELECT id, {words(_flat('prompt'))} AS tail, array_to_string(string_split(prompt, ' ')[-5:], ' ') || ': ' || answer AS a FROM answers)"]
    for i in range(3):
        k = "coalesce(list_max([k FOR k IN range(3, 11) IF k <= len(tail) AND k <= len(head) AND tail[len(tail) - k + 1:len(tail)] = head[1:k]]), 0)"
        out.append(f"h{i} AS (SELECT *, ({words('a')})[1:10] AS head FROM e{i}), k{i} AS (SELECT *, {k} AS n FROM h{i})")
        out.append(rf"e{i + 1} AS (SELECT id, tail, CASE WHEN n > 0 THEN regexp_replace(a, '^{other}*(?:{letter}+{other}+){{' || (n - 1) || '}}{letter}+[ \t\r\n:;,.!?\-–—]*', '') ELSE a END AS a FROM k{i})")
    return "WITH " + ", ".join(out) + r" SELECT id, regexp_replace(a, '^\s+|\s+$', '', 'g') AS t FROM e3"


@Q.add("i13_prompt_echo", _echo_sql())
def i13(spark, sf):
    """Answers behind the last five words of their prompts."""
    words = F.split("prompt", " ")
    end = F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - 4), F.lit(5)), " ")
    return answers(spark, sf).select("id", T.strip_prompt_echo(F.concat(end, F.lit(": "), F.col("answer")), F.col("prompt")).alias("t"))


@Q.add("i14_subject", "SELECT c_custkey, c_name AS subject FROM customer")
def i14(spark, sf):
    """Names found again in four forms of question: the template, quotes, before 's, and the last capitalised run."""
    t, k = "Where does {SUBJECT} live?", F.col("c_custkey") % 4
    forms = [F.lit('Who is called "{SUBJECT}" here?'), F.lit("What is {SUBJECT}'s home?"), F.lit("Please tell of {SUBJECT} now")]
    asked = F.when(k == 0, forms[0]).when(k == 1, forms[1]).when(k == 2, forms[2]).otherwise(t)
    return read(spark, sf, "customer").select("c_custkey", T.subject(T.fill_template(asked, F.col("c_name")), t).alias("subject"))


@Q.add("i14_subject_of_prompts")
def i14p(spark, sf):
    """What the prompts and answers of conversations are about, by quotes, 's and capitals; SQL lacks the lookbehind."""
    a = answers(spark, sf)
    return a.select("id", *[T.subject(F.col(c), "Where does {SUBJECT} live?").alias(c) for c in ("prompt", "answer")])


@Q.add("i15_task", f"""WITH {ANSWERS}, p AS (SELECT id, prompt || [' father''s name?', ' Which Instrument?', ' godfather', ''][id % 4 + 1] AS p FROM answers)
    SELECT id, CASE WHEN regexp_matches(p, '(?i)\\bfather\\b') THEN 'father' WHEN regexp_matches(p, '(?i)\\binstrument\\b') THEN 'instrument' END AS task FROM p""")
def i15(spark, sf):
    k = F.col("id") % 4
    more = F.when(k == 0, " father's name?").when(k == 1, " Which Instrument?").when(k == 2, " godfather").otherwise("")
    return answers(spark, sf).select("id", T.task_of(F.concat("prompt", more)).alias("task"))


_RAW = ["Refusal", " hallucination ", "CORRECT", "other", "", "Incorrect", "1", "0", "refuse", "HALLU", "Abstain", "value-providing", "nan", "non-hallucination", "WRONG", "hallucinated!", "refused", None]


@Q.add(
    "i16_label_normalisers",
    f"""WITH r AS (SELECT event_id, {_words_sql([])[:-1]}{", ".join(map(_text, _RAW))}][event_id % {len(_RAW)} + 1] AS x FROM events), u AS (SELECT *, upper(trim(coalesce(x, ''))) AS u, lower(trim(coalesce(x, ''))) AS l, upper(trim(x)) AS v FROM r) SELECT event_id,
    CASE WHEN u = '' THEN 'UNKNOWN' WHEN u LIKE '%REFUS%' THEN 'REFUSAL' WHEN u LIKE '%HALL%' THEN 'HALLUCINATION' WHEN u LIKE '%CORR%' THEN 'CORRECT' ELSE u END AS a,
    CASE WHEN l IN ('refusal', 'refuse') THEN 'refusal' WHEN l IN ('hallucination', 'hallucinate') THEN 'hallucination' WHEN l IN ('unknown', 'nan', 'none', '') THEN 'other' ELSE l END AS b,
    CASE WHEN v IN ('REFUSAL', 'HALLUCINATION', 'OTHER') THEN v ELSE 'OTHER' END AS c,
    CASE WHEN l IN ('hallucination', 'hallucinate', 'hallu') THEN 'HALLUCINATION' WHEN l IN ('refusal', 'refuse', 'non-hallucination', 'nonhallucination', 'non_hallucination', 'other') THEN 'REFUSAL' ELSE 'unknown' END AS d,
    CASE WHEN v IN ('REFUSAL', 'ABSTAIN', 'ABSTENTION', '0') THEN 'REFUSAL' WHEN v IN ('HALLUCINATION', 'VALUE', 'VALUE_PROVIDING', 'VALUE-PROVIDING', '1') THEN 'HALLUCINATION' WHEN v LIKE '%REFUS%' THEN 'REFUSAL' WHEN v LIKE '%HALL%' OR v LIKE '%VALUE%' THEN 'HALLUCINATION' ELSE v END AS e FROM u""",
)
def i16(spark, sf):
    x = F.element_at(F.array(*map(F.lit, _RAW)), (F.col("event_id") % len(_RAW) + 1).cast("int"))
    rules = {"a": A.by_substring, "b": A.lower_label, "c": A.three_or_other, "d": A.judge_label, "e": A.value_label}
    return read(spark, sf, "events").select("event_id", *[f(x).alias(n) for n, f in rules.items()])


@Q.add("i17_keys", "SELECT p_partkey, replace(replace(replace(lower(trim(p_type)), '-', '_'), '/', '_'), ' ', '_') AS k, ['gemma_7b_it','llama3_1_8b_instruct','qwen2_5_7b_instruct'][p_partkey % 3 + 1] AS model FROM part")
def i17(spark, sf):
    m = F.element_at(F.array(F.lit("google/gemma-7b-it"), F.lit("meta-llama/Llama-3.1-8B-Instruct"), F.lit("Qwen/Qwen2.5-7B-Instruct")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return read(spark, sf, "part").select("p_partkey", T.normal_key(F.col("p_type")).alias("k"), T.normal_model(m).alias("model"))


@Q.add("i18_casefold", f"WITH {ANSWERS} SELECT id, trim(regexp_replace(lower(answer), '\\s+', ' ', 'g')) AS t FROM answers")
def i18(spark, sf):
    return answers(spark, sf).select("id", T.casefold_answer(F.col("answer")).alias("t"))


@Q.add("i19_collision_key", "SELECT s_suppkey, regexp_replace(lower(strip_accents(s_name)), '[^\\w]+', '', 'g') AS k FROM supplier")
def i19(spark, sf):
    return read(spark, sf, "supplier").select("s_suppkey", T.collision_key(F.col("s_name")).alias("k"))


@Q.add("i20_similarity")
def i20(spark, sf):
    """Ratcliff-Obershelp similarity of supplier names with a fixed one."""
    return read(spark, sf, "supplier").select("s_suppkey", F.round(T.similarity(F.col("s_name"), F.lit("Supplier#000000001")), 6).alias("ratio"))


@Q.add("i21_title_case", "SELECT n_nationkey, array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(n_name, ' ')], ' ') AS t FROM nation")
def i21(spark, sf):
    return read(spark, sf, "nation").select("n_nationkey", T.title_case(F.col("n_name")).alias("t"))


@Q.add("i22_fnv1a")
def i22(spark, sf):
    return read(spark, sf, "nation").select("n_name", T.fnv1a_32(F.col("n_name")).alias("h"))


@Q.add("i23_json_reply", "SELECT event_id, event_type AS label, value AS confidence FROM events")
def i23(spark, sf):
    raw = F.concat(F.lit("```json\n{\"label\": \""), F.col("event_type"), F.lit('", "confidence": '), F.col("value").cast("string"), F.lit("}\n```"))
    return read(spark, sf, "events").select("event_id", T.json_field(raw, "label").alias("label"), T.json_field(raw, "confidence").cast("double").alias("confidence"))


@Q.add("i23_json_props", "SELECT event_id, props->>'k' AS k, NULL::VARCHAR AS none FROM events")
def i23p(spark, sf):
    """A field of the events' own JSON, inside a reply with words around it."""
    raw = F.concat(F.lit("Here it is: "), F.col("props"), F.lit(" - as asked."))
    return read(spark, sf, "events").select("event_id", T.json_field(raw, "k").alias("k"), T.json_field(raw, "missing").alias("none"))


@Q.add("i24_formats", "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN 'p<1e-300' ELSE 'p=' || printf('%.4f', l_tax) END AS p, printf('%.3f [%.3f,%.3f]', l_tax, l_tax - l_discount, l_tax + l_discount) AS ci FROM lineitem")
def i24(spark, sf):
    t, d = F.col("l_tax"), F.col("l_discount")
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", N.p_text(t).alias("p"), N.ci_text(t, t - d, t + d).alias("ci"))


@Q.add("i25_clip_log_tanh", "SELECT event_id, round(least(50, greatest(10, value)),6) AS c, round(ln(value+1),6) AS l, round(tanh(value/100),6) AS t, round(atanh(least(0.99, value/200)),6) AS a FROM events")
def i25(spark, sf):
    v = F.col("value")
    r = lambda c, n: F.round(c, 6).alias(n)
    return read(spark, sf, "events").select("event_id", r(N.clip(v, 10, 50), "c"), r(F.log(v + 1), "l"), r(F.tanh(v / 100), "t"), r(F.atanh(F.least(F.lit(0.99), v / 200)), "a"))


_FATHER_SQL = f"coalesce({_is('answer', A.FATHER)}, false)"
_INSTRUMENT_SQL = f"(contains(lower(coalesce(answer, '')), 'played') AND {_is(chr(108) + 'ower(coalesce(answer, chr(32)))', '|'.join(A.INSTRUMENTS))})"


@Q.add("i26_guess_detectors", f"WITH {VARIED} SELECT id, CASE WHEN {_substring('answer')} AND NOT (CASE (id // 2) % 3 WHEN 0 THEN {_FATHER_SQL} WHEN 1 THEN {_INSTRUMENT_SQL} ELSE false END) THEN 'refusal' ELSE 'hallucination' END AS label FROM varied")
def i26(spark, sf):
    k = F.floor(F.col("id") / 2) % 3
    task = F.when(k == 0, "father").when(k == 1, "instrument").otherwise("other")
    return varied(spark, sf).select("id", A.label_two_way(F.col("answer"), F.col("answer"), task).alias("label"))


@Q.add("i27_surname_rate", "SELECT s_nationkey, round(avg((s_suppkey % 2 = 0)::INT),6) AS rate FROM supplier GROUP BY 1")
def i27(spark, sf):
    a = F.concat(F.lit("Ann "), F.col("s_name"))
    b = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Bob "), F.col("s_name"))).otherwise("Bob Other")
    return read(spark, sf, "supplier").groupBy("s_nationkey").agg(F.round(F.avg(T.same_surname(a, b).cast("int")), 6).alias("rate"))


@Q.add("i28_label_sources", "SELECT event_id, upper(event_type) AS label FROM events")
def i28(spark, sf):
    k, t = F.col("event_id") % 3, F.col("event_type")
    e = read(spark, sf, "events")
    return e.select("event_id", A.label_of(F.when(k == 0, t), F.when(k == 1, t), F.when(k == 2, F.to_json(F.struct(t.alias("label"))))).alias("label"))


# --- J: labelers ------------------------------------------------------------


def _correct_v1(t: str) -> str:
    return f"""CASE WHEN contains(relation, 'gender') OR gc IS NOT NULL THEN gc IS NOT NULL AND coalesce(gc = {_category(t)}, false) ELSE {_has_tokens(t, "gt")} END"""


@Q.add(
    "j01_label_v1",
    f"""WITH {FORMS}, k AS (SELECT id, relation, t, after, {_tokens("gold")} AS gt, {_tokens("answer")} AS wt, {_tokens("after")} AS st FROM forms), c AS (SELECT *, {_category("gt")} AS gc FROM k)
    SELECT id, CASE WHEN ({_correct_v1("st")}) OR ({_correct_v1("wt")}) THEN 'CORRECT' WHEN {_refusal_v1("t")} OR {_refusal_v1("after")} THEN 'REFUSAL' ELSE 'HALLUCINATION' END AS label FROM c""",
)
def j01(spark, sf):
    return varied(spark, sf).select("id", A.label_v1(F.col("answer"), F.lit(""), F.col("gold"), F.col("relation")).alias("label"))


_CLEAN_LOOSE = "(gs <> '' AND contains(' ' || cs || ' ', ' ' || gs || ' '))"


@Q.add(
    "j02_label_final",
    f"""WITH {FORMS}, k AS (SELECT *, {_simple("clean")} AS cs, {_simple("gold")} AS gs, {_simple("cand")} AS vs, lower({_flat("clean")}) AS lc, trim(lower({_flat("gold")})) AS lg FROM forms),
    w AS (SELECT *, [x FOR x IN string_split(cs, ' ') IF x <> ''] AS cw, [x FOR x IN string_split(vs, ' ') IF len(x) >= 2 AND NOT list_contains({_words_sql(A.STUB_WORDS)}, x)] AS vw FROM k),
    v AS (SELECT *, cand <> '' AND vs <> '' AND vs NOT IN ({", ".join(map(_text, A.PLACEHOLDERS))}) AND NOT {_any_sql("cand", A.REFUSAL_FINAL)} AND len(vw) > 0 AS names_value,
      len(cw) = 0 OR (len(cw) <= 12 AND len([x FOR x IN cw IF NOT list_contains({_words_sql(A.STUB_WORDS)}, x)]) = 0) AS stub,
      CASE WHEN contains(relation, 'gender') AND gs IN ('men', 'women') THEN {_canonical("cs")} = {_canonical("gs")} ELSE lg <> '' AND ({_stands("lc", "lg")} OR {_CLEAN_LOOSE}) END AS right FROM w)
    SELECT id, CASE WHEN right THEN 'CORRECT' WHEN clean = '' OR ({_any_sql("clean", A.REFUSAL_FINAL)} AND NOT names_value) OR (NOT names_value AND stub) THEN 'REFUSAL' ELSE 'HALLUCINATION' END AS label FROM v""".replace(" AS right", " AS is_right").replace("WHEN right THEN", "WHEN is_right THEN"),
)
def j02(spark, sf):
    v = varied(spark, sf).withColumn("clean", A.clean_answer(F.col("answer"), F.lit("")))
    return v.select("id", A.label_final(F.col("clean"), F.col("gold"), F.col("relation")).alias("label"))


def _word_in(t: str, words: list[str]) -> str:
    return _is(t, rf"(?i)(^|{_NO_WORD})(?:{'|'.join(words)})($|{_NO_WORD})")


@Q.add(
    "j03_label_refusal_first",
    f"""WITH {FORMS}, k AS (SELECT id, short, lower(g) AS g, {_word_in("short", A.MALE_RCW)} AS m, {_word_in("short", A.FEMALE_RCW)} AS f FROM forms)
    SELECT id, CASE WHEN short = '' OR {_is("short", A.PLACEHOLDER)} OR {_any_sql("short", A.REFUSAL_RCW)} OR {_is("short", A.STOCK)} THEN 'REFUSAL'
      WHEN CASE g WHEN 'men' THEN m AND NOT f WHEN 'women' THEN f AND NOT m ELSE {_stands("short", "g")} END THEN 'CORRECT' ELSE 'WRONG' END AS label FROM k""",
)
def j03(spark, sf):
    return varied(spark, sf).select("id", A.label_rcw(F.col("answer"), F.col("gold")).alias("label"))


@Q.add("j04_binary_judge", f"WITH {FORMS} SELECT id, CASE WHEN t = '' OR {_is('lower(t)', A.PLACEHOLDER)} OR {_any_sql('t', A.REFUSAL_V1)} OR {_is('lower(t)', A.STOCK)} THEN 'REFUSAL' ELSE 'HALLUCINATION' END AS label FROM forms")
def j04(spark, sf):
    return varied(spark, sf).select("id", A.judge_binary(F.col("answer")).alias("label"))


@Q.add("j05_two_way", f"WITH {VARIED} SELECT id, CASE WHEN {_substring('answer')} AND NOT {_FATHER_SQL} THEN 'refusal' ELSE 'hallucination' END AS label FROM varied")
def j05(spark, sf):
    return varied(spark, sf).select("id", A.label_two_way(F.col("answer"), F.col("answer"), F.lit("father")).alias("label"))


@Q.add(
    "j06_rule_sanity",
    f"""WITH {FORMS}, k AS (SELECT relation, {_any_sql("t", A.REFUSAL_FINAL)} OR t = '' AS refusal, {_has_tokens(_tokens("answer"), _tokens("gold"))} AS hit FROM forms)
    SELECT relation, count(*) AS n, count(*) FILTER (refusal) AS n_refusal, count(*) FILTER (NOT refusal) AS n_value, count(*) FILTER (NOT refusal AND hit) AS n_correct, count(*) FILTER (NOT refusal AND NOT hit) AS n_wrong FROM k GROUP BY 1""",
)
def j06(spark, sf):
    """Refusals, values, and values with and without the gold."""
    t = T.normalize_text(F.col("answer"))
    v = varied(spark, sf).select("relation", (F.rlike(t, A._any(A.REFUSAL_FINAL)) | (t == "")).alias("refusal"), T.contains_tokens(T.tokens(F.col("answer")), T.tokens(F.col("gold"))).alias("hit"))
    no = ~F.col("refusal")
    return v.groupBy("relation").agg(F.count("*").alias("n"), F.count_if("refusal").alias("n_refusal"), F.count_if(no).alias("n_value"), F.count_if(no & F.col("hit")).alias("n_correct"), F.count_if(no & ~F.col("hit")).alias("n_wrong"))


@Q.add("j07_collision_verdict")
def j07(spark, sf):
    """Every supplier's name against the first one's: the same key, similar from 0.93 on, or clean; SQL has no such similarity."""
    base = F.lit("Supplier#000000001")
    name = F.col("s_name")
    return read(spark, sf, "supplier").select("s_suppkey", A.verdict((T.collision_key(name) == T.collision_key(base)).cast("int"), T.similarity(name, base, 0.93)).alias("verdict"))
