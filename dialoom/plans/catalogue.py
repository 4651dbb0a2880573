"""The queries of the core, each over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from dialoom.functions import chat, clean, metrics, predicates as P, scoring
from dialoom.functions.rules import DEFAULT
from dialoom.operators import grouping, joins, quota, repair, reports, splits
from dialoom.plans import selection_sql as Q, sql as S
from dialoom.session import cut, spread, table
from dialoom.sources import writers
from dialoom.streaming import jobs as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _candidate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidate")


def _wide(spark: SparkSession, d: str, name: str = "candidate") -> DataFrame:
    """A table for work that is heavy per row."""
    return spread(table(spark, d, name))


def _asked(name: str = "context"):
    return F.coalesce(F.element_at(name, -1), F.lit(""))


# Cleaning


@query(f"SELECT line_no, i - 1 AS turn_no, {S.clean_turn('t')} AS clean FROM (SELECT line_no, unnest(context) AS t, generate_subscripts(context, 1) AS i FROM candidate)")
def clean_turns(spark: SparkSession, d: str) -> DataFrame:
    turns = _wide(spark, d).select("line_no", F.posexplode("context").alias("turn_no", "t"))
    return turns.select("line_no", F.col("turn_no").cast("long").alias("turn_no"), clean.clean_turn("t").alias("clean"))


@query(f"SELECT line_no, {S.mask_key('response')} AS mask_key, {S.template_key('response')} AS template FROM candidate WHERE response IS NOT NULL")
def reply_keys(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d).where("response is not null").select("line_no", clean.mask_key("response").alias("mask_key"), clean.template_key("response").alias("template"))


@query(f"SELECT {S.template_key('response')} AS value, count(*) AS n FROM candidate WHERE response IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 80")
def template_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = _wide(spark, d).where("response is not null")
    return quota.most_frequent(rows, clean.template_key("response"), 80)


@query(f"SELECT group_id, array_to_string(list_transform(context, lambda t: {S.mask_key('t')}), ' || ') AS context_key FROM group_selection")
def masked_contexts(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d, "group_selection").select("group_id", clean.masked_context("context").alias("context_key"))


@query(f"SELECT repair_id, {S.repair_clean('chosen')} AS clean, {S.compact('chosen')} AS compact, {S.repair_key('chosen')} AS key FROM repair_group")
def repair_texts(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d, "repair_group").select("repair_id", clean.repair_clean("chosen").alias("clean"), clean.compact("chosen").alias("compact"), clean.repair_key("chosen").alias("key"))


@query(f"SELECT doc_id, {S.light_clean('text')} AS clean FROM documents")
def light_documents(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d, "documents").select("doc_id", clean.light_clean("text").alias("clean"))


@query(f"SELECT doc_id, {S.clean_document('text')} AS clean, {S.normalize_masked_first('text')} AS masked FROM documents WHERE text IS NOT NULL")
def clean_documents(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d, "documents").where("text is not null").select("doc_id", clean.clean_document("text").alias("clean"), clean.normalize_masked_first("text").alias("masked"))


@query(f"SELECT repair_id, {S.clean_output('rejected')} AS clean, {S.without_masks('chosen')} AS unmasked FROM repair_group")
def clean_outputs(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d, "repair_group").select("repair_id", clean.clean_output("rejected").alias("clean"), clean.without_masks("chosen").alias("unmasked"))


@query(f"SELECT line_no, text AS trimmed, trims FROM ({Q.trimmed('SELECT line_no, ' + chr(99) + 'oalesce(response, ' + chr(39) * 2 + ') AS r FROM candidate', 'r')})")
def trimmed_tails(spark: SparkSession, d: str) -> DataFrame:
    trimmed = clean.trim_tail(F.coalesce("response", F.lit("")))
    return _wide(spark, d).select("line_no", trimmed["text"].alias("trimmed"), F.size(trimmed["issues"]).alias("trims"))


# Predicates, scores, categories

_R, _A = "coalesce(response, '')", "coalesce(context[-1], '')"


@query(
    f"""SELECT line_no, {S.question_strength('a')} AS strength, {S.garbage('r')} AS garbage, {S.low_info('r')} AS low_info, {S.any_of('t', DEFAULT.temporal)} AS dated, {S.any_of('t', DEFAULT.soft)} AS soft,
    {S.any_of('t', DEFAULT.pitch)} AS pitch, {S.any_of('t', DEFAULT.shop_names)} AS shop_name, {S.any_of('t', DEFAULT.overcommit)} AS overcommits, {S.any_of('t', DEFAULT.hard_risk)} AS hard_risk, {S.any_of('t', DEFAULT.refund_promise)} AS refund_promise,
    {S.hits('t', DEFAULT.high_risk)} AS high_risk, len(list_filter(regexp_split_to_array(t, '[，。！？；!?;]'), lambda e: e <> '')) AS clauses
    FROM (SELECT line_no, {_R} AS r, {S.tight(_R)} AS t, {_A} AS a FROM candidate)"""
)
def reply_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = _wide(spark, d).select("line_no", F.coalesce("response", F.lit("")).alias("r"), _asked().alias("a"))
    flags = {
        "strength": P.question_strength("a"), "garbage": P.is_garbage("r"), "low_info": P.is_low_info("r"), "dated": P.has_dated_campaign("r"), "soft": P.has_soft_template("r"), "pitch": P.is_pitch("r"),
        "shop_name": P.has_shop_name("r"), "overcommits": P.overcommits("r"), "hard_risk": P.has_hard_risk("r"), "refund_promise": P.promises_refund("r"), "high_risk": P.high_risk_hits("r"), "clauses": P.clause_count("r"),
    }
    return rows.select("line_no", *[c.alias(n) for n, c in flags.items()])


def _masked_sql() -> str:
    full = "|".join(DEFAULT.fragments).replace("'", "''")
    mask = S.mask_key("r")
    kinds = " + ".join(f"{S.any_of('t', words)}::INT" for words in (DEFAULT.shop_names, DEFAULT.operations, DEFAULT.policies))
    first = f"(regexp_matches(f, '^({'|'.join(DEFAULT.incomplete)})') OR {S.low_info('f')})"
    return f"""SELECT line_no, {S.any_of('lower(r)', tuple(w.lower() for w in DEFAULT.blocked))} AS blocked,
    contains(lower(r), '<|im_') OR regexp_matches(r, '(?im)^\\s*(user|assistant|system)([^{S.WORD}]|$)') OR regexp_matches(r, '(?m)^\\s*(用户|客服|买家|卖家)\\s*[：:]') AS role_leak,
    regexp_matches(r, '[\\x{{0600}}-\\x{{06ff}}\\x{{0e00}}-\\x{{0e7f}}\\x{{0400}}-\\x{{04ff}}\\x{{ac00}}-\\x{{d7af}}]') AS other_script, {kinds} AS store, coalesce(len(context), 0) >= 2 AND {first} AS incomplete,
    (length(t) <= 3 OR regexp_matches(t, '^(?:{full})$') OR (length(t) <= 8 AND NOT {S.any_of('t', DEFAULT.complete)})) AS fragment,
    regexp_matches({mask}, '(?i)^(?:{'|'.join(DEFAULT.generic)})') AS generic, regexp_matches({mask}, '{'|'.join(DEFAULT.time_promise)}') AS time_promise,
    (k = '' OR k IN ('<ID>', '<PHONE>', '<NUM>', '<YEAR>') OR {S.any_of('k', DEFAULT.contact)}) AS bad FROM (SELECT line_no, context, {_R} AS r, {S.tight(_R)} AS t, {S.tight("coalesce(context[1], '')")} AS f, {S.compact(_R)} AS k FROM candidate)"""


@query(_masked_sql())
def reply_flags_masked(spark: SparkSession, d: str) -> DataFrame:
    rows = _wide(spark, d).select("line_no", "context", F.coalesce("response", F.lit("")).alias("r"))
    flags = {
        "blocked": P.has_blocked("r"), "role_leak": P.has_role_leak("r"), "other_script": P.has_other_script("r"), "store": F.size(P.store_specific("r")), "incomplete": P.incomplete_start("context"), "fragment": P.is_fragment("r"),
        "generic": P.is_generic("r"), "time_promise": P.promises_time("r"), "bad": P.is_bad("r"),
    }
    return rows.select("line_no", *[c.alias(n) for n, c in flags.items()])


def _unasked_sql() -> str:
    flags = ", ".join(f"CASE WHEN {S.any_of('t', own)} AND NOT {S.any_of('b', wide)} THEN {S.q(name)} END" for name, own, wide in DEFAULT.expansions)
    return f"SELECT line_no, array_to_string(list_filter([{flags}], lambda e: e IS NOT NULL), ',') AS topics FROM (SELECT line_no, {S.tight(_R)} AS t, {S.tight(_A)} AS b FROM candidate)"


@query(_unasked_sql())
def unasked_topics(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d).select("line_no", F.array_join(P.unasked_topics(_asked(), F.coalesce("response", F.lit(""))), ",").alias("topics"))


@query(
    f"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN coalesce(len(context), 0) < 2 THEN 'too_few_turns' WHEN length(r) < 6 THEN 'too_short'
    WHEN r IN ('', '<ID>', '<PHONE>') OR {S.any_of('r', DEFAULT.blocked)} THEN 'bad_reply' WHEN {S.low_info('r')} THEN 'low_info' ELSE 'ok' END AS reason
    FROM (SELECT context, {S.strip(_R)} AS r FROM candidate)) GROUP BY 1"""
)
def keep_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d).groupBy(P.keep_reason("context", F.coalesce("response", F.lit("")), 2).alias("reason")).agg(F.count("*").alias("n"))


@query(
    f"""SELECT line_no, round(({S.keyword_overlap('x', 'y')}) * 1000000)::BIGINT AS overlap, len(x) AS asked_tokens, len(y) AS reply_tokens
    FROM (SELECT line_no, {S.tokens('a')} AS x, {S.tokens('r')} AS y FROM (SELECT line_no, {_R} AS r, {_A} AS a FROM candidate))"""
)
def keyword_overlaps(spark: SparkSession, d: str) -> DataFrame:
    rows = _wide(spark, d).select("line_no", scoring.overlap_tokens(_asked()).alias("x"), scoring.overlap_tokens(F.coalesce("response", F.lit(""))).alias("y"))
    return rows.select("line_no", F.round(scoring.overlap_of(F.col("x"), F.col("y")) * 1000000).cast("long").alias("overlap"), F.size("x").alias("asked_tokens"), F.size("y").alias("reply_tokens"))


@query(
    f"""SELECT line_no, round(c_score * 10000)::BIGINT AS score, round(CASE WHEN {' OR '.join(f"len(list_filter(turns, lambda e: {S.any_of(S.tight('e'), w)})) > 0" for w in (DEFAULT.shop_names, DEFAULT.operations, DEFAULT.policies))}
    OR (len(turns) >= 2 AND (regexp_matches({S.tight('turns[1]')}, '^({'|'.join(DEFAULT.incomplete)})') OR {S.low_info('turns[1]')})) THEN -999 ELSE c_score END * 10000)::BIGINT AS generic_score, c_issues AS issues
    FROM ({Q.steps("SELECT line_no, context AS turns, context[-1] AS asked FROM candidate WHERE len(context) > 0", Q.context_terms())})"""
)
def context_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = _wide(spark, d).where("size(context) > 0")
    own, generic = scoring.context_score("context"), scoring.context_score("context", scoring.Mode(generic=True))
    return rows.select("line_no", F.round(own["score"] * 10000).cast("long").alias("score"), F.round(generic["score"] * 10000).cast("long").alias("generic_score"), F.size(own["issues"]).alias("issues"))


@query(
    f"""SELECT line_no, {S.first_category(DEFAULT.categories, lambda w: f"({S.any_of('r', w)} OR {S.any_of('a', w)})")} AS category, {S.first_category(DEFAULT.repair_categories, lambda w: S.any_of('k', w))} AS repair_category
    FROM (SELECT line_no, {S.tight(_R)} AS r, {S.tight(_A)} AS a, {S.compact(_A)} AS k FROM candidate)"""
)
def categories(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d).select("line_no", scoring.category(_asked(), F.coalesce("response", F.lit(""))).alias("category"), scoring.repair_category(_asked()).alias("repair_category"))


_MODES = {"normal": scoring.NORMAL, "strict": scoring.Mode(strict=True), "sft": scoring.Mode(sft=True), "generic": scoring.Mode(generic=True), "strict_sft": scoring.Mode(strict=True, sft=True)}
_SCORED = "SELECT line_no, context AS turns, context[-1] AS asked, response AS reply FROM candidate WHERE len(context) > 0 AND response IS NOT NULL"


@query("SELECT line_no, " + ", ".join(f"{n}.s AS {n}, {n}.i AS {n}_issues" for n in _MODES) + " FROM " + " JOIN ".join(f"(SELECT line_no, round(score * 10000)::BIGINT AS s, n_issues AS i FROM ({Q.positive(_SCORED, m)})) {n}" + (" USING (line_no)" if i else "") for i, (n, m) in enumerate(_MODES.items())))
def reply_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = _wide(spark, d).where("size(context) > 0 and response is not null")
    scored = rows.select("line_no", F.explode(F.array(F.struct(*[scoring.positive_score("context", "response", m).alias(n) for n, m in _MODES.items()]))).alias("s"))
    return scored.select("line_no", *[F.round(F.col(f"s.{n}.score") * 10000).cast("long").alias(n) for n in _MODES], *[F.size(f"s.{n}.issues").alias(f"{n}_issues") for n in _MODES])


_WORSE = "SELECT group_id, context AS turns, context[-1] AS asked, rejected AS reply, chosen AS best FROM group_selection WHERE len(context) > 0 AND chosen IS NOT NULL AND rejected IS NOT NULL"


@query(f"SELECT group_id, a.s AS normal, a.i AS issues, b.s AS strict FROM (SELECT group_id, round(score * 10000)::BIGINT AS s, n_issues AS i FROM ({Q.negative(_WORSE)})) a JOIN (SELECT group_id, round(score * 10000)::BIGINT AS s FROM ({Q.negative(_WORSE, scoring.Mode(strict=True))})) b USING (group_id)")
def worse_reply_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = _wide(spark, d, "group_selection").where("size(context) > 0 and chosen is not null and rejected is not null")
    score = lambda m: scoring.negative_score("context", "rejected", "chosen", m)
    scored = rows.select("group_id", F.explode(F.array(F.struct(score(scoring.NORMAL).alias("a"), score(scoring.Mode(strict=True)).alias("b")))).alias("s"))
    return scored.select("group_id", F.round(F.col("s.a.score") * 10000).cast("long").alias("normal"), F.size("s.a.issues").alias("issues"), F.round(F.col("s.b.score") * 10000).cast("long").alias("strict"))


_RISK = " + ".join(f"CASE WHEN contains(w, {S.q(word)}) THEN {weight} ELSE 0 END" for word, weight in DEFAULT.risks)
_RISK_SQL = f"""SELECT line_no, ({_RISK} + CASE WHEN length(r) > 24 THEN 0.8 ELSE 0 END + CASE WHEN length(r) - length(replace(r, '亲', '')) >= 4 THEN 0.5 ELSE 0 END)::DOUBLE AS risk
    FROM (SELECT line_no, {_R} AS r, array_to_string(context, chr(10)) || chr(10) || {_R} AS w FROM candidate)"""


_ROW_RISK = " + ".join([f"CASE WHEN contains(r, {S.q(w)}) THEN {v} ELSE 0 END" for w, v in DEFAULT.risks] + [f"CASE WHEN contains(a, {S.q(w)}) THEN {v} ELSE 0 END" for w, v in DEFAULT.input_risks])


@query(
    f"""SELECT line_no, round(risk * 1000)::BIGINT AS risk, round(row_risk * 1000)::BIGINT AS row_risk FROM ({_RISK_SQL}) JOIN (SELECT line_no, ({_ROW_RISK} + CASE WHEN length(r) > 24 THEN 0.8 ELSE 0 END + CASE WHEN length(r) - length(replace(r, '亲', '')) >= 4 THEN 0.5 ELSE 0 END)::DOUBLE AS row_risk
    FROM (SELECT line_no, {_R} AS r, {_A} AS a FROM candidate)) USING (line_no)"""
)
def risk_scores(spark: SparkSession, d: str) -> DataFrame:
    risk, row = scoring.risk_score("response", "context"), scoring.record_risk(_asked(), "response")
    return _wide(spark, d).select("line_no", F.round(risk * 1000).cast("long").alias("risk"), F.round(row * 1000).cast("long").alias("row_risk"))


# Grouping and selection


def _pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cands = cut(grouping.candidates(_wide(spark, d)))
    return cands, cut(grouping.best_pairs(cands))


@query(f"WITH {Q.best_pairs()} SELECT context_key, chosen, rejected, category, round(score * 10000)::BIGINT AS score, pos_line_no, neg_line_no, first_line FROM best")
def best_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d)[1].select("context_key", "chosen", "rejected", "category", F.round(F.col("score") * 10000).cast("long").alias("score"), "pos_line_no", "neg_line_no", "first_line")


@query(
    f"""WITH {Q.best_pairs()} SELECT count(*) AS context_groups, count(*) FILTER (p = 0) AS no_positive, count(*) FILTER (p > 0 AND n = 0) AS no_negative, (SELECT count(*) FROM best) AS kept,
    count(*) FILTER (p > 0 AND n > 0) - (SELECT count(*) FROM best) AS rejected FROM firsts"""
)
def group_stats(spark: SparkSession, d: str) -> DataFrame:
    return grouping.group_stats(*_pairs(spark, d))


def best_reply_pairs(spark: SparkSession, d: str, top_k: int = 200) -> DataFrame:
    """Clean, score, pair, select: the flagship."""
    picked = quota.diverse_topk(_pairs(spark, d)[1], grouping.pair_order(), top_k, quota.category_caps(top_k))
    return picked.select("rank", "pass_no", "category", "context", "chosen", "rejected", F.bround("score", 4).alias("score"), "pos_line_no", "neg_line_no")


_RANKED_PAIRS = f"""SELECT row_number() OVER (ORDER BY score DESC, len(context) DESC, length(chosen), first_line) AS rank, category AS k0, {S.template_key('chosen')} AS k1, {S.mask_key('asked')} AS k2, {S.template_key(S.mask_key('asked') + " || ' || ' || chosen")} AS k3, pos_line_no, neg_line_no, chosen, rejected FROM best"""


@query(f"WITH RECURSIVE {Q.best_pairs()}, {Q.two_passes(_RANKED_PAIRS, 200, quota.category_caps(200))} SELECT p.rank, p.pass_no, r.k0 AS category, r.chosen, r.rejected, r.pos_line_no, r.neg_line_no FROM picked p JOIN r USING (rank)")
def selected_pairs(spark: SparkSession, d: str) -> DataFrame:
    return best_reply_pairs(spark, d).select("rank", "pass_no", "category", "chosen", "rejected", "pos_line_no", "neg_line_no")


def _capped_groups(spark: SparkSession, d: str) -> tuple:
    rows = table(spark, d, "group_selection").withColumns({"template": clean.template_key(F.coalesce("chosen", F.lit(""))), "asked_key": clean.mask_key(_asked())})
    rows = rows.withColumns({"pair_key": grouping.pair_key("asked_key", F.coalesce("chosen", F.lit(""))), "category": F.lower(F.trim("category"))})
    return rows, [F.desc("score"), F.asc("group_id")], 300, quota.category_caps(300)


_RANKED_GROUPS = f"""SELECT group_id, row_number() OVER (ORDER BY score DESC, group_id) AS rank, coalesce(nullif(lower(trim(category)), ''), 'other') AS k0, {S.template_key("coalesce(chosen, '')")} AS k1, {S.mask_key(_A)} AS k2, {S.template_key(S.mask_key(_A) + " || ' || ' || coalesce(chosen, '')")} AS k3 FROM group_selection"""
_TOP_GROUPS = f"WITH RECURSIVE {Q.two_passes(_RANKED_GROUPS, 300, quota.category_caps(300))}"


@query(f"{_TOP_GROUPS} SELECT group_id, rank, pass_no FROM picked JOIN r USING (rank)")
def quota_topk(spark: SparkSession, d: str) -> DataFrame:
    return quota.diverse_topk(*_capped_groups(spark, d)).select("group_id", "rank", "pass_no")


@query(f"{_TOP_GROUPS} {Q.counters(['drop_category', 'drop_template', 'drop_question', 'drop_pair'])}")
def quota_drops(spark: SparkSession, d: str) -> DataFrame:
    return quota.topk_counters(*_capped_groups(spark, d))


@query("SELECT count(*) AS total_lines, count(*) FILTER (label IS NULL) AS parse_failed, count(*) FILTER (label = 0) AS label_0, count(*) FILTER (label = 1) AS label_1 FROM candidate")
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return grouping.label_counts(_candidate(spark, d))


@query(
    f"""SELECT c AS context, a AS first_line, p AS chosen, r AS rejected FROM (SELECT array_to_string(context, chr(10)) AS c, min(line_no) AS a, arg_max(response, line_no) FILTER (label = 1 AND response IS NOT NULL) AS p, arg_max(response, line_no) FILTER (label = 0 AND response IS NOT NULL) AS r
    FROM candidate GROUP BY 1) WHERE {S.strip("coalesce(p, '')")} <> '' AND {S.strip("coalesce(r, '')")} <> '' AND {S.strip('p')} <> {S.strip('r')}"""
)
def last_write_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = _candidate(spark, d).where("response is not null").withColumn("context", F.array_join("context", "\n"))
    out = grouping.last_write_pairs(rows, ["context"])
    first = _candidate(spark, d).groupBy(F.array_join("context", "\n").alias("context")).agg(F.min("line_no").alias("first_line"))
    return out.drop("first_line").join(first, "context").select("context", "first_line", "chosen", "rejected")


@query(
    """SELECT shop_id, run_id::BIGINT AS run_id, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS rows FROM (SELECT *, sum(ch) OVER (PARTITION BY shop_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS run_id
    FROM (SELECT shop_id, line_no, label, (label IS DISTINCT FROM lag(label) OVER (PARTITION BY shop_id ORDER BY line_no))::INT AS ch FROM candidate)) GROUP BY 1, 2"""
)
def run_length_groups(spark: SparkSession, d: str) -> DataFrame:
    return grouping.run_groups(_candidate(spark, d), F.col("label"), within=["shop_id"]).select("shop_id", "run_id", "first_line", "last_line", "rows")


@query("SELECT min(line_no) AS first_line, count(*) AS rows, coalesce(arg_min_null(CASE WHEN label = 1 THEN response END, CASE WHEN label = 1 THEN line_no END), '') AS positive FROM candidate GROUP BY context")
def context_lines(spark: SparkSession, d: str) -> DataFrame:
    return grouping.context_lines(_candidate(spark, d)).select("first_line", F.size("lines").alias("rows"), "positive")


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def exact_dedup_first(spark: SparkSession, d: str) -> DataFrame:
    return grouping.exact_first(table(spark, d, "documents"), [F.col("text")], "doc_id").select("doc_id", "lang")


@query("SELECT id, count(*) AS deliveries, max(scored_at) AS scored_at, arg_max(result, scored_at) AS result FROM (SELECT DISTINCT * FROM preference_rows) GROUP BY id")
def preference_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "preference_rows").distinct()
    return rows.groupBy("id").agg(F.count("*").alias("deliveries"), F.max("scored_at").alias("scored_at"), F.max_by("result", "scored_at").alias("result"))


# Splits, samples, noise

_SPLIT = "SELECT *, ['train', 'train', 'train', 'dev', 'test'][((row_number() OVER (PARTITION BY category ORDER BY score DESC, group_id) - 1) % 5 + 1)::INT] AS split FROM group_selection"


@query(f"SELECT group_id, category, split FROM ({_SPLIT})")
def category_pattern_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.pattern_split(table(spark, d, "group_selection"), "category", [F.desc("score"), F.asc("group_id")]).select("group_id", "category", "split")


@query(
    f"""SELECT split, sum(n)::BIGINT AS rows, round_even(sum(s) / sum(n), 4)::DOUBLE AS mean_score, min(lo) AS min_rank, max(hi) AS max_rank, array_to_string(list_sort(list(category || ':' || n)), ',') AS categories
    FROM (SELECT split, coalesce(category, '') AS category, count(*) AS n, sum(score) AS s, min(group_id) AS lo, max(group_id) AS hi FROM ({_SPLIT}) GROUP BY 1, 2) GROUP BY 1"""
)
def split_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = splits.pattern_split(table(spark, d, "group_selection"), "category", [F.desc("score"), F.asc("group_id")])
    out = splits.split_stats(rows, rank="group_id")
    entries = F.array_sort(F.transform(F.map_entries("categories"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))))
    return out.withColumn("categories", F.array_join(entries, ","))


@query("SELECT doc_id, n <= greatest(1, floor(m * 0.05)) AS is_validation FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS n, count(*) OVER () AS m FROM documents)")
def hash_holdout(spark: SparkSession, d: str) -> DataFrame:
    return splits.holdout(table(spark, d, "documents"), "doc_id", 0.05).select("doc_id", "is_validation")


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('7|' || doc_id), doc_id) AS sample_rank FROM documents QUALIFY sample_rank <= 200")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return splits.sample_indices(table(spark, d, "documents"), "doc_id", 200, 7)


@query(
    """SELECT repair_id, CASE WHEN s THEN rejected ELSE chosen END AS chosen, CASE WHEN s THEN chosen ELSE rejected END AS rejected, s AS noise_swapped, i - 1 AS source_index FROM (SELECT *, row_number() OVER (ORDER BY md5('42|' || repair_id), repair_id) <= round_even((SELECT count(*) FROM repair_group) * 0.1, 0) AS s,
    row_number() OVER (ORDER BY repair_id) AS i FROM repair_group)"""
)
def noise_swap(spark: SparkSession, d: str) -> DataFrame:
    return splits.add_noise(table(spark, d, "repair_group"), "repair_id", 0.1).select("repair_id", "chosen", "rejected", "noise_swapped", "source_index")


@query(
    f"""WITH r AS ({_RISK_SQL}), w AS (SELECT line_no FROM r ORDER BY round(risk * 1000) DESC, line_no DESC LIMIT 25)
    SELECT line_no, shop_id FROM candidate WHERE line_no NOT IN (SELECT line_no FROM w) UNION ALL SELECT -n_nationkey - 1, n_regionkey FROM nation"""
)
def risk_topn_replace(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "nation").select((-F.col("n_nationkey").cast("long") - 1).alias("line_no"), F.col("n_regionkey").alias("shop_id"))
    rows = _candidate(spark, d)
    return splits.replace_riskiest(rows, "line_no", F.round(scoring.risk_score("response", "context") * 1000), made).select("line_no", "shop_id")


@query("SELECT n_name || ' / ' || r_name AS dialogue, (n_nationkey * 10 + r_regionkey)::INT AS place FROM nation, region")
def scenario_cross_wrapper(spark: SparkSession, d: str) -> DataFrame:
    both = splits.scenarios(table(spark, d, "nation"), table(spark, d, "region"))
    return both.select(F.concat_ws(" / ", "n_name", "r_name").alias("dialogue"), (F.col("n_nationkey") * 10 + F.col("r_regionkey")).alias("place"))


# Repair


def _repaired(spark: SparkSession, d: str) -> DataFrame:
    return repair.with_keys(repair.repair_pairs(_wide(spark, d, "repair_group")))


@query(f"WITH {Q.repaired()} SELECT repair_id, kind AS repair_category, text AS repaired_chosen, worse AS repaired_rejected, round(repair_score * 10000)::BIGINT AS repair_score, array_to_string(list_sort(list_distinct(all_issues)), ',') AS issues FROM repaired")
def repaired_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = repair.repair_pairs(_wide(spark, d, "repair_group"))
    return rows.select("repair_id", "repair_category", "repaired_chosen", "repaired_rejected", F.round(F.col("repair_score") * 10000).cast("long").alias("repair_score"), F.array_join(F.array_sort("repair_issues"), ",").alias("issues"))


@query(Q.repaired_selection(300))
def repaired_selection(spark: SparkSession, d: str) -> DataFrame:
    caps = {n: int(300 * s) for n, s in quota.REPAIR_SHARES.items()}
    return quota.diverse_repaired(_repaired(spark, d), repair.order([F.asc("repair_id")]), 300, caps, "template", "asked_key", "repair_category", same=repair.SAME).select("repair_id", "rank", "pass_no", "repair_category")


def _pick_sql() -> str:
    cases = " ".join(f"WHEN c = {S.q(n)} THEN [{', '.join(map(S.q, t))}][h % {len(t)} + 1]" for n, t in sorted(DEFAULT.negatives.items()))
    kind = S.first_category(DEFAULT.repair_categories, lambda w: S.any_of("k", w))
    return f"SELECT repair_id, CASE {cases} END AS template FROM (SELECT repair_id, {kind} AS c, ('0x' || substr(md5(k), 1, 8))::BIGINT AS h FROM (SELECT repair_id, {S.compact(_A)} AS k FROM repair_group))"


@query(_pick_sql())
def md5_template_pick(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "repair_group").select("repair_id", repair.template_pick(_asked(), scoring.repair_category(_asked())).alias("template"))


@query(
    """SELECT * FROM (SELECT 'category' AS kind, coalesce(category, '') AS value, count(*) AS n FROM repair_group GROUP BY 2 UNION ALL SELECT 'source', coalesce(source, ''), count(*) FROM repair_group GROUP BY 2
    UNION ALL (SELECT 'issue', i, count(*) AS n FROM (SELECT unnest(issues) AS i FROM repair_group) GROUP BY 2 ORDER BY n DESC, i LIMIT 100))"""
)
def issue_distribution(spark: SparkSession, d: str) -> DataFrame:
    return repair.distributions(table(spark, d, "repair_group"))


@query("SELECT repair_id, source FROM repair_group WHERE source IS DISTINCT FROM 'manual_round2' UNION ALL SELECT repair_id, source FROM repair_group WHERE source = 'manual_round2'")
def concatenated_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "repair_group").select("repair_id", "source")
    manual = F.coalesce(F.col("source") == "manual_round2", F.lit(False))
    return rows.where(~manual).unionByName(rows.where(manual))


# Formats

_LINES = "array_to_string(list_transform(context, lambda t, i: CASE WHEN i % 2 = 1 THEN '用户：' ELSE '客服：' END || coalesce(t, '')), chr(10))"


@query(f"SELECT line_no, {_LINES} AS prompt, CASE WHEN ends_with({_LINES}, chr(10) || '客服：') THEN {_LINES} ELSE {_LINES} || chr(10) || '客服：' END AS open_prompt FROM candidate WHERE context IS NOT NULL")
def role_prefixed_prompts(spark: SparkSession, d: str) -> DataFrame:
    return _candidate(spark, d).where("context is not null").select("line_no", chat.prompt_lines("context").alias("prompt"), chat.open_prompt("context").alias("open_prompt"))


@query(
    f"""SELECT line_no, {S.q(chat.TASK)} AS instruction, {S.q(chat.TASK)} || chr(10) || '' || chr(10) || array_to_string(list_transform(context, lambda t, i: CASE WHEN regexp_matches(t, '^(用户|客服)：') THEN t ELSE CASE WHEN i % 2 = 1 THEN '用户：' ELSE '客服：' END || coalesce(t, '') END), chr(10)) || chr(10) || '客服：' AS input,
    response AS output FROM candidate WHERE context IS NOT NULL AND response IS NOT NULL"""
)
def alpaca_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = _candidate(spark, d).where("context is not null and response is not null")
    return rows.select("line_no", chat.alpaca(F.lit(chat.TASK), chat.task_prompt("context"), F.col("response")).alias("r")).select("line_no", "r.*")


_OPEN = f"CASE WHEN ends_with({_LINES}, chr(10) || '客服：') THEN {_LINES} ELSE {_LINES} || chr(10) || '客服：' END"


@query(
    f"""SELECT line_no, turns, len(list_filter(regexp_split_to_array(p, '用户：|客服：')[2:], lambda e: {S.light_clean('e')} <> '')) AS parsed
    FROM (SELECT line_no, len(context) AS turns, {S.light_clean(_OPEN)} AS p, {S.light_clean('response')} AS r FROM candidate WHERE len(context) > 0 AND response IS NOT NULL) WHERE r <> ''"""
)
def parse_turns_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = _wide(spark, d).where("size(context) > 0 and response is not null")
    made = rows.select("line_no", "context", chat.alpaca_to_messages(F.lit(chat.SYSTEM), chat.open_prompt("context"), "response").alias("messages"))
    return made.where("messages is not null").select("line_no", F.size("context").alias("turns"), (F.size("messages") - 2).alias("parsed"))


_NORMAL = f"list_filter(list_transform(coalesce(messages, []), lambda m: {{'role': lower({S.strip(chr(99) + 'oalesce(m.role, ' + chr(39) * 2 + ')')}), 'content': {S.plain_text('m.content')}}}), lambda m: m.role IN ('system', 'user', 'assistant') AND m.content <> '')"
_SYSTEM = f"{{'role': 'system', 'content': {S.q(chat.SYSTEM)}}}"
_ML = "array_to_string(list_transform({0}, lambda m: '<|im_start|>' || m.role || chr(10) || m.content || '<|im_end|>' || chr(10)), '')"


@query(
    f"""SELECT msg_id, {_ML.format(f"list_concat([{_SYSTEM}], list_filter(t[1:len(t) - 1], lambda m, i: NOT (i = 1 AND m.role = 'system')))")} || '<|im_start|>assistant' || chr(10) AS prompt,
    CASE WHEN ends_with(c, '<|im_end|>') OR ends_with(c, '<|endoftext|>') THEN c ELSE c || '<|im_end|>' END AS completion
    FROM (SELECT msg_id, t, {S.sub("t[len(t)].content", f"{S.WS}+$", "")} AS c FROM (SELECT msg_id, {_NORMAL} AS t FROM messages_sft) WHERE len(t) >= 2 AND t[len(t)].role = 'assistant')"""
)
def prompt_completion(spark: SparkSession, d: str) -> DataFrame:
    return chat.convert_rows(_wide(spark, d, "messages_sft").select("msg_id", "messages")).select("msg_id", "prompt", "completion")


@query(f"SELECT msg_id, {_ML.format('t')} AS text, len(t) AS turns FROM (SELECT msg_id, {_NORMAL} AS t FROM messages_sft)")
def chatml_render(spark: SparkSession, d: str) -> DataFrame:
    rows = _wide(spark, d, "messages_sft").select("msg_id", chat.normal_messages("messages").alias("t"))
    return rows.select("msg_id", chat.chatml(F.col("t")).alias("text"), F.size("t").alias("turns"))


@query(
    f"""SELECT msg_id, u AS last_user, t[len(t)].content AS reference FROM (SELECT msg_id, t, list_filter(t[1:len(t) - 1], lambda m: m.role = 'user')[-1].content AS u FROM (SELECT msg_id, {_NORMAL} AS t FROM messages_sft) WHERE len(t) >= 2 AND t[len(t)].role = 'assistant') WHERE u IS NOT NULL"""
)
def last_turn_prompts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "messages_sft").select("msg_id", chat.eval_view("messages").alias("v")).where("v is not null")
    return rows.select("msg_id", "v.last_user", "v.reference")


@query(
    f"SELECT repair_id, CASE WHEN ends_with(c, '<|im_end|>') OR ends_with(c, '<|endoftext|>') THEN c ELSE c || '<|im_end|>' END AS a, CASE WHEN ends_with(c, '<|im_end|>') OR ends_with(c, '<|endoftext|>') THEN c ELSE c || '<|im_end|><|endoftext|>' END AS b FROM (SELECT repair_id, {S.sub(chr(34) + 'chosen' + chr(34), S.WS + '+$', '')} AS c FROM repair_group WHERE chosen IS NOT NULL)"
)
def completion_suffixes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "repair_group").where("chosen is not null").select("repair_id", chat.terminated(F.col("chosen")).alias("a"), chat.terminated(F.col("chosen"), "both").alias("b"))


def _preference_sql() -> str:
    head = f"^(?i)(用户|买家|user|客服|卖家|assistant|系统|system){S.WS}*[：:]"
    start, word, body, line = f"regexp_matches({S.strip('l')}, {S.q(head)})", f"lower(regexp_extract({S.strip('l')}, {S.q(head)}, 1))", S.strip(S.sub(S.strip("l"), head, "")), S.strip("l")
    role = f"CASE WHEN {word} IN ('客服', '卖家', 'assistant') THEN 'assistant' WHEN {word} IN ('系统', 'system') THEN 'system' ELSE 'user' END"
    text = f"array_to_string(list_transform(list_filter(string_split({S.plain_text('p')}, chr(10)), lambda l: {line} <> ''), lambda l, i: CASE WHEN {start} THEN chr(2) || {role} || chr(1) || {body} WHEN i = 1 THEN chr(2) || 'user' || chr(1) || {line} ELSE chr(10) || {line} END), '')"
    turns = f"list_filter(list_transform(string_split({text}, chr(2))[2:], lambda m: {{'role': split_part(m, chr(1), 1), 'content': {S.strip('split_part(m, chr(1), 2)')}}}), lambda m: m.content <> '')"
    done = lambda c: f"CASE WHEN ends_with({c}, '<|im_end|>') OR ends_with({c}, '<|endoftext|>') THEN {c} ELSE {c} || '<|im_end|>' END"
    system = f"CASE WHEN t[1].role = 'system' THEN list_concat([{_SYSTEM}], t[2:]) ELSE list_concat([{_SYSTEM}], t) END"
    return f"""SELECT repair_id, {_ML.format(f'({system})')} || '<|im_start|>assistant' || chr(10) AS prompt, {done('c')} AS chosen, {done('j')} AS rejected
    FROM (SELECT repair_id, {turns} AS t, c, j FROM (SELECT repair_id, {_LINES} AS p, {S.plain_text('chosen')} AS c, {S.plain_text('rejected')} AS j FROM repair_group)) WHERE c <> '' AND j <> '' AND c <> j AND t[len(t)].role = 'user'"""


@query(_preference_sql())
def preference_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "repair_group").select("repair_id", chat.prompt_lines("context").alias("prompt"), "chosen", "rejected")
    return chat.convert_preferences(rows)


@query(f"SELECT repair_id, p AS prompt, CASE WHEN ends_with(c, '<|im_end|>') OR ends_with(c, '<|endoftext|>') THEN c ELSE c || '<|im_end|>' END AS completion FROM (SELECT repair_id, {S.plain_text(_LINES)} AS p, {S.plain_text('chosen')} AS c FROM repair_group) WHERE p <> '' AND c <> ''")
def completion_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "repair_group").select("repair_id", chat.prompt_lines("context").alias("prompt"), F.col("chosen").alias("completion"))
    return chat.convert_rows(rows)


@query(
    f"""SELECT msg_id, CASE WHEN len(t) > 0 THEN {_ML.format(f"list_concat([{_SYSTEM}], list_filter(t, lambda m, i: NOT (i = 1 AND m.role = 'system')))")} || '<|im_start|>assistant' || chr(10) WHEN s <> '' THEN {_ML.format(f"list_concat([{_SYSTEM}], [{{'role': 'user', 'content': s}}])")} || '<|im_start|>assistant' || chr(10) END AS prompt
    FROM (SELECT msg_id, {S.plain_text('source')} AS s, CASE WHEN t[len(t)].role = 'assistant' THEN t[1:len(t) - 1] ELSE t END AS t FROM (SELECT msg_id, source, {_NORMAL} AS t FROM messages_sft))"""
)
def preference_prompts(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d, "messages_sft").select("msg_id", chat.preference_prompt(F.lit(""), F.col("messages"), F.col("source")).alias("prompt"))


@query(
    f"""SELECT line_no, {S.q(chat.SYSTEM)} AS instruction, {S.q(chat.TASK)} || chr(10) || chr(10) || '客服：' || city || chr(10) || '用户：' || a || chr(10) || '客服：' AS input, response AS output, 4 AS messages
    FROM (SELECT line_no, shop_id, context[-1] AS a, response FROM candidate WHERE len(context) > 0 AND response IS NOT NULL) JOIN (SELECT shop_id, city FROM shop WHERE city IS NOT NULL) USING (shop_id)"""
)
def made_dialogues(spark: SparkSession, d: str) -> DataFrame:
    rows = _candidate(spark, d).where("size(context) > 0 and response is not null").join(table(spark, d, "shop").where("city is not null").select("shop_id", "city"), "shop_id")
    turns = chat.dialogue_turns(F.array(chat.message("assistant", F.col("city"))), F.array().cast(chat.MESSAGES), _asked())
    made = rows.select("line_no", chat.turns_sample(turns, F.col("response")).alias("r"), F.size(chat.turns_messages(turns, F.col("response"))).alias("messages"))
    return made.select("line_no", "r.*", "messages")


@query("SELECT line_no, label::VARCHAR || chr(9) || array_to_string(context, chr(9)) || chr(9) || response AS line FROM candidate WHERE response IS NOT NULL AND context IS NOT NULL")
def raw_lines(spark: SparkSession, d: str) -> DataFrame:
    return _candidate(spark, d).where("response is not null and context is not null").select("line_no", writers.raw_line("label", "context", "response").alias("line"))


@query(f"SELECT repair_id, {S.strip(chr(99) + 'oalesce(chosen, ' + chr(39) * 2 + ')')} <> '' AND {S.strip(chr(99) + 'oalesce(rejected, ' + chr(39) * 2 + ')')} <> '' AND {S.strip(chr(99) + 'oalesce(chosen, ' + chr(39) * 2 + ')')} <> {S.strip(chr(99) + 'oalesce(rejected, ' + chr(39) * 2 + ')')} AS valid FROM repair_group")
def valid_pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "repair_group").select("repair_id", P.valid_pair("chosen", "rejected").alias("valid"))


# Joins


@query(
    """SELECT b.repair_id, b.margin AS margin, a.margin AS base_margin FROM (SELECT * FROM preference_rows WHERE run_name = 'dpo_mix' AND error IS NULL) b JOIN (SELECT repair_id, arg_max(margin, id) AS margin FROM preference_rows WHERE run_name = 'sft_base' AND error IS NULL GROUP BY 1) a USING (repair_id)"""
)
def align_two_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "preference_rows").where("error is null")
    base = rows.where("run_name = 'sft_base'").select("repair_id", "id", "margin")
    out = joins.align(base, rows.where("run_name = 'dpo_mix'").select("repair_id", "id", "margin"), ["repair_id"], "id")
    return out.select("repair_id", "margin", F.col("base.margin").alias("base_margin"))


@query(
    """WITH RECURSIVE items AS (SELECT group_id, row_number() OVER (ORDER BY group_id) AS n, pos_line_no AS p, neg_line_no AS q FROM group_selection),
    fine AS (SELECT n, list(repair_id ORDER BY repair_id) AS f FROM items JOIN repair_group r ON r.pos_line_no = p AND r.neg_line_no = q GROUP BY 1), wide AS (SELECT n, list(repair_id ORDER BY repair_id) AS w FROM items JOIN repair_group r ON r.pos_line_no = p GROUP BY 1),
    both_ AS MATERIALIZED (SELECT n, group_id, coalesce(f, []) AS f, coalesce(w, []) AS w FROM items LEFT JOIN fine USING (n) LEFT JOIN wide USING (n)),
    walk AS (SELECT 0::BIGINT AS n, 0::BIGINT AS group_id, []::BIGINT[] AS used, NULL::BIGINT AS a, NULL::BIGINT AS b UNION ALL
      SELECT n, group_id, CASE WHEN coalesce(a, b) IS NULL THEN used ELSE list_append(used, coalesce(a, b)) END, a, b FROM (SELECT i.n, i.group_id, used, list_filter(i.f, lambda e: NOT list_contains(used, e))[1] AS a, list_filter(i.w, lambda e: NOT list_contains(used, e))[1] AS b FROM walk JOIN both_ i ON i.n = walk.n + 1))
    SELECT group_id, coalesce(a, b) AS repair_id, CASE WHEN a IS NULL THEN 1 ELSE 0 END AS level FROM walk WHERE coalesce(a, b) IS NOT NULL"""
)
def cascade_match(spark: SparkSession, d: str) -> DataFrame:
    return joins.cascade(table(spark, d, "group_selection"), table(spark, d, "repair_group"), [["pos_line_no", "neg_line_no"], ["pos_line_no"]], "group_id", "repair_id")


@query("SELECT w.repair_id, w.margin, l.margin AS loss_margin FROM (SELECT repair_id, arg_max(margin, id) AS margin FROM preference_rows WHERE result = 'win' GROUP BY 1) w LEFT JOIN (SELECT repair_id, arg_max(margin, id) AS margin FROM preference_rows WHERE result = 'loss' GROUP BY 1) l USING (repair_id)")
def win_loss_join(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "preference_rows")
    last = lambda kind: joins.last_per_key(rows.where(F.col("result") == kind).select("repair_id", "id", "margin"), "repair_id", "id").drop("id")
    return joins.star(last("win"), [last("loss").withColumnRenamed("margin", "loss_margin")], "repair_id")


@query("SELECT msg_id FROM messages_sft SEMI JOIN (SELECT msg_id FROM (SELECT msg_id, row_number() OVER (ORDER BY md5('3|' || msg_id), msg_id) AS n FROM messages_sft) WHERE n <= 100) USING (msg_id)")
def sampled_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "messages_sft")
    return rows.join(splits.exact_head(rows.select("msg_id"), "msg_id", 100, 3), "msg_id", "left_semi").select("msg_id")


# Metrics and reports

_CHARS = "CASE WHEN {0} = '' THEN [] ELSE string_split({0}, '') END"
_BARE = lambda x: S.sub(f"coalesce({x}, '')", S.WS, "")


@query(
    f"""SELECT repair_id, em AS exact_match, common, len(x) AS left_size, len(y) AS right_size, CASE WHEN common > 0 THEN round(2e6 * common / (len(x) + len(y)))::BIGINT ELSE 0 END AS char_f1
    FROM (SELECT *, coalesce(list_sum(list_transform(list_distinct(x), lambda c: least(len(list_filter(x, lambda e: e = c)), len(list_filter(y, lambda e: e = c))))), 0)::INT AS common
    FROM (SELECT repair_id, ({S.strip("coalesce(chosen, '')")} = {S.strip("coalesce(rejected, '')")})::INT AS em, {_CHARS.format(_BARE('chosen'))} AS x, {_CHARS.format(_BARE('rejected'))} AS y FROM repair_group))"""
)
def char_f1(spark: SparkSession, d: str) -> DataFrame:
    rows = _wide(spark, d, "repair_group").select("repair_id", metrics.exact_match("chosen", "rejected").alias("exact_match"), metrics.characters("chosen").alias("x"), metrics.characters("rejected").alias("y"))
    rows = rows.withColumn("common", metrics.common_characters(F.col("x"), F.col("y")))
    return rows.select("repair_id", "exact_match", "common", F.size("x").alias("left_size"), F.size("y").alias("right_size"), F.round(metrics.f1_of(F.col("common"), F.size("x"), F.size("y")) * 1000000).cast("long").alias("char_f1"))


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    return reports.evaluated(_wide(spark, d, "repair_group").select("repair_id", F.col("rejected").alias("prediction"), F.col("chosen").alias("reference")))


_METRICS = f"""WITH RECURSIVE texts AS MATERIALIZED (SELECT repair_id, ({S.strip("coalesce(chosen, '')")} = {S.strip("coalesce(rejected, '')")})::INT AS em, {_CHARS.format(_BARE('rejected'))} AS x, {_CHARS.format(_BARE('chosen'))} AS y FROM repair_group),
    lcs AS (SELECT repair_id, x, y, 0 AS i, list_transform(y, lambda e: 0) AS row_ FROM texts UNION ALL
      SELECT repair_id, x, y, i + 1, list_transform(y, lambda e, j: greatest(row_[j], coalesce(list_max(list_transform(list_filter(range(1, j + 1), lambda k: y[k] = x[i + 1]), lambda k: coalesce(row_[k - 1], 0) + 1)), 0))) FROM lcs WHERE i < len(x)),
    longest AS (SELECT repair_id, coalesce(arg_max(row_[len(y)], i), 0) AS l FROM lcs GROUP BY 1),
    counted AS (SELECT texts.*, l, len(x) AS n, len(y) AS m, coalesce(list_sum(list_transform(list_distinct(x), lambda c: least(len(list_filter(x, lambda e: e = c)), len(list_filter(y, lambda e: e = c))))), 0)::INT AS common FROM texts JOIN longest USING (repair_id)),
    scored AS (SELECT repair_id, em AS exact_match, round_even(CASE WHEN common > 0 THEN 2 * (common / n::DOUBLE) * (common / m::DOUBLE) / (common / n::DOUBLE + common / m::DOUBLE) ELSE 0 END, 6) AS char_f1,
      round_even(CASE WHEN n > 0 AND m > 0 THEN (1 + 1.44::DOUBLE) * (l / n::DOUBLE) * (l / m::DOUBLE) / (l / m::DOUBLE + 1.44::DOUBLE * (l / n::DOUBLE) + 1e-12) ELSE 0 END, 6) AS rouge_l FROM counted)"""
_MILLIONTHS = "round(char_f1 * 1000000)::BIGINT AS char_f1, round(rouge_l * 1000000)::BIGINT AS rouge_l"


def _millionths(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n) * 1000000).cast("long") for n in names})


@query(f"{_METRICS} SELECT repair_id, {_MILLIONTHS}, exact_match FROM scored")
def rouge_scores(spark: SparkSession, d: str) -> DataFrame:
    return _millionths(_evaluated(spark, d).select("repair_id", "char_f1", "rouge_l", "exact_match"), "char_f1", "rouge_l")


@query(f"{_METRICS} SELECT repair_id, {_MILLIONTHS}, exact_match FROM (SELECT * FROM scored ORDER BY char_f1, rouge_l, exact_match, repair_id LIMIT 100)")
def bad_cases(spark: SparkSession, d: str) -> DataFrame:
    return _millionths(reports.bad_cases(_evaluated(spark, d), 100, "repair_id").select("repair_id", "char_f1", "rouge_l", "exact_match"), "char_f1", "rouge_l")


@query(f"{_METRICS} SELECT count(*) AS rows, {', '.join(f'round(avg({n}) * 100000)::BIGINT AS {n}' for n in ('exact_match', 'char_f1', 'rouge_l'))} FROM scored")
def metric_means(spark: SparkSession, d: str) -> DataFrame:
    return reports.metric_means(_evaluated(spark, d)).withColumns({n: F.round(F.col(n) * 100000).cast("long") for n in ("exact_match", "char_f1", "rouge_l")})


_OUTCOME = "CASE WHEN chosen_logprob IS NULL OR rejected_logprob IS NULL OR isnan(chosen_logprob) OR isnan(rejected_logprob) OR isinf(chosen_logprob) OR isinf(rejected_logprob) THEN 'error' WHEN chosen_logprob > rejected_logprob THEN 'win' WHEN chosen_logprob = rejected_logprob THEN 'tie' ELSE 'loss' END"


@query(f"SELECT id, {_OUTCOME} AS outcome, round(CASE WHEN {_OUTCOME} <> 'error' THEN chosen_logprob - rejected_logprob END * 10000)::DOUBLE AS margin FROM preference_rows")
def preference_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return reports.preference_rows(table(spark, d, "preference_rows")).select("id", "outcome", F.round(F.col("new_margin") * 10000).alias("margin"))


_SUMMARY = f"""SELECT run_name, count(*) AS rows, count(*) FILTER (o <> 'error') AS valid, round(coalesce(count(*) FILTER (o = 'win') / nullif(count(*) FILTER (o <> 'error'), 0)::DOUBLE, 0) * 1000000)::BIGINT AS accuracy,
    round(coalesce(count(*) FILTER (o = 'tie') / nullif(count(*) FILTER (o <> 'error'), 0)::DOUBLE, 0) * 1000000)::BIGINT AS tie_rate FROM (SELECT run_name, {_OUTCOME} AS o FROM preference_rows) GROUP BY 1"""


@query(_SUMMARY)
def preference_summary(spark: SparkSession, d: str) -> DataFrame:
    out = reports.preference_summary(reports.preference_rows(table(spark, d, "preference_rows")), ["run_name"])
    scaled = lambda c: F.round(F.col(c) * 1000000).cast("long").alias(c)
    return out.select("run_name", "rows", "valid", scaled("accuracy"), scaled("tie_rate"))


@query(f"SELECT s.run_name, s.accuracy, s.accuracy - b.accuracy AS accuracy_delta, s.tie_rate - b.tie_rate AS tie_rate_delta FROM ({_SUMMARY}) s LEFT JOIN (SELECT * FROM ({_SUMMARY}) WHERE run_name = 'sft_base') b ON true")
def baseline_deltas(spark: SparkSession, d: str) -> DataFrame:
    out = joins.against_baseline(preference_summary(spark, d), "run_name", "sft_base", ["accuracy", "tie_rate"])
    return out.select("run_name", "accuracy", "accuracy_delta", "tie_rate_delta")


@query("SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity) * 100)::BIGINT AS loss, round(sum(l_linenumber) / sum(l_quantity) * 1000000)::BIGINT AS accuracy, sum(l_quantity)::BIGINT AS tokens FROM lineitem GROUP BY 1")
def token_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("loss"), F.col("l_quantity").alias("tokens"), F.col("l_linenumber").alias("correct"))
    out = reports.weighted_loss(rows, by=["l_returnflag"])
    return out.select("l_returnflag", F.round(F.col("loss") * 100).cast("long").alias("loss"), F.round(F.col("token_accuracy") * 1000000).cast("long").alias("accuracy"), F.col("tokens").cast("long").alias("tokens"))


@query("SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) * 10000)::BIGINT AS smoothed FROM events")
def moving_average(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    return rows.select("event_id", "user_id", F.round(reports.moving_average("value", "event_id", 5, ["user_id"]) * 10000).cast("long").alias("smoothed"))


@query("SELECT event_type, max(floor(try_cast(value AS DOUBLE)))::BIGINT AS peak_mb, quantile_disc(floor(try_cast(value AS DOUBLE)), 0.95)::BIGINT AS p95_mb FROM events GROUP BY 1")
def telemetry_peak(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_type", F.col("value").cast("string").alias("memory_used_mb"))
    return reports.telemetry_peaks(rows, ["event_type"])


@query("SELECT repair_id FROM repair_group WHERE contains(lower(concat_ws(' ', source, chosen, rejected)), 'lex')")
def keyword_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "repair_group").where(P.mentions(["source", "chosen", "rejected"], "LEX")).select("repair_id")


@query(
    f"""WITH k AS (SELECT category, {S.template_key("coalesce(chosen, '')")} AS t, {S.mask_key(_A)} AS q FROM group_selection) SELECT 'category' AS kind, category AS value, count(*) AS n FROM k GROUP BY 2
    UNION ALL (SELECT 'template', t, count(*) AS n FROM k GROUP BY 2 ORDER BY n DESC, t LIMIT 80) UNION ALL (SELECT 'question', q, count(*) AS n FROM k GROUP BY 2 ORDER BY n DESC, q LIMIT 80)"""
)
def selection_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = _wide(spark, d, "group_selection").withColumns({"template": clean.template_key(F.coalesce("chosen", F.lit(""))), "asked_key": clean.mask_key(_asked())})
    return writers.selection_stats(rows)


@query(
    f"SELECT c.*, CASE WHEN run_name = 'dpo_mix' THEN round((b.a - accuracy) / b.a * 1000) WHEN run_name = 'sft_base' THEN 0 END::DOUBLE AS saving FROM (SELECT run_name, accuracy FROM ({_SUMMARY})) c, (SELECT accuracy AS a FROM ({_SUMMARY}) WHERE run_name = 'sft_base') b"
)
def run_saving(spark: SparkSession, d: str) -> DataFrame:
    out = joins.saving(preference_summary(spark, d).select("run_name", "accuracy"), "run_name", "dpo_mix", "sft_base", "accuracy")
    return out.withColumn("saving", F.round(F.col("saving") * 10))


@query(
    """SELECT s.run_name, s.step, d.seconds, d.seconds IS NOT NULL AS skip FROM (SELECT DISTINCT run_name, unnest(['train', 'eval', 'collect']) AS step FROM preference_rows WHERE run_name IN ('sft_base', 'dpo_mix')) s
    LEFT JOIN (SELECT run_name, 'eval' AS step, max(chosen_tokens) AS seconds FROM preference_rows WHERE error IS NULL GROUP BY 1) d USING (run_name, step)"""
)
def run_steps(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "preference_rows")
    done = rows.where("error is null").select("run_name", F.lit("eval").alias("step"), F.col("chosen_tokens").alias("seconds"))
    return reports.run_steps(rows.select("run_name").distinct(), done, ["sft_base", "dpo_mix"], key="run_name")


# Streams


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS rows FROM events GROUP BY 1, 2")
def streamed_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = streams.run_once(streams.window_counts(streams.read_stream(spark, d, "events"), ["event_type"], time="ts", late="30 days"))
    return rows.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "rows")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, max(floor(value))::BIGINT AS peak FROM events GROUP BY 1, 2")
def streamed_peaks(spark: SparkSession, d: str) -> DataFrame:
    rows = streams.run_once(streams.peak_stream(streams.read_stream(spark, d, "events"), value="value", by=("event_type",), size="1 hour", late="30 days"))
    return rows.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "event_type", F.col("peak").cast("long").alias("peak"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
