"""SQL of scoring, pairing, repair and selection, for checking them in another engine.

Written from the rules, step by step as nested selects; sums are in the order of
the rules, in doubles, so that equal scores are equal in both engines."""

from __future__ import annotations

from dialoom.functions import scoring
from dialoom.functions.rules import DEFAULT, Pack
from dialoom.functions.scoring import BANDS, REJECTED, STRICT_BANDS, TAIL, Mode
from dialoom.operators import quota
from dialoom.plans import sql as S

EDGES = "[ ，。！？；、,.!?;:'\"~～]"


def steps(base: str, *columns: dict[str, str]) -> str:
    """Nested selects, each of which adds columns to those before."""
    for new in columns:
        base = f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in new.items())} FROM ({base})"
    return base


def _points(test: str, value: float) -> str:
    return f"CASE WHEN {test} THEN {value!r}::DOUBLE ELSE 0::DOUBLE END"


def _bare(x: str) -> str:
    return S.sub(x, f"^{EDGES}+|{EDGES}+$", "")


def trimmed(base: str, x: str) -> str:
    """Adds `text` and `trims` (their number) of a reply."""
    return steps(
        base,
        {"o": S.strip(x)},
        {"once": S.sub("o", f"({TAIL}[，。！ ]*){{2,}}", TAIL)},
        {"short_": _bare(S.sub("once", f"[，。！ ]*请(您)?{TAIL[1:]}.*$", ""))},
        {"polite": S.strip(S.squeeze(_bare(S.sub("short_", "(好的|嗯嗯|恩恩|哦哦|亲亲){2,}$", ""))))},
        {"text": "CASE WHEN polite = '' THEN o ELSE polite END", "trims": f"(once <> o)::INT + (short_ <> {_bare('once')})::INT"},
    )


def signs(base: str, pack: Pack = DEFAULT) -> str:
    """Adds what scores are made of, from `asked` and `text`."""
    unasked = " + ".join(f"({S.any_of('tt', own)} AND NOT {S.any_of('ta', wide)})::INT" for _, own, wide in pack.expansions)
    full = "|".join(pack.fragments).replace("'", "''")
    return steps(
        base,
        {"tt": S.tight("text"), "ta": S.tight("asked"), "mk": S.mask_key("text"), "ax": S.tokens("asked", pack), "rx": S.tokens("text", pack), "strength": S.question_strength("asked", pack)},
        {
            "size": "length(tt)", "clauses": "len(list_filter(regexp_split_to_array(tt, '[，。！？；!?;]'), lambda e: e <> ''))", "unasked": unasked, "risky": S.hits("tt", pack.high_risk),
            "kind": S.first_category(pack.categories, lambda w: f"({S.any_of('tt', w)} OR {S.any_of('ta', w)})"), "actions": S.hits("tt", pack.actions), "near": S.keyword_overlap("ax", "rx"),
            "dated": S.any_of("tt", pack.temporal), "soft": S.any_of("tt", pack.soft), "generic": f"regexp_matches(mk, '(?i)^(?:{'|'.join(pack.generic)})')", "pitch": S.any_of("tt", pack.pitch), "over_": S.any_of("tt", pack.overcommit),
            "blocked": S.any_of("lower(text)", tuple(w.lower() for w in pack.blocked)), "garbage": S.garbage("text"), "low": S.low_info("text", pack), "timely": f"regexp_matches(mk, '{'|'.join(pack.time_promise)}')",
            "leak": f"contains(lower(text), '<|im_') OR regexp_matches(text, '(?im)^\\s*(user|assistant|system)([^{S.WORD}]|$)') OR regexp_matches(text, '(?m)^\\s*(用户|客服|买家|卖家)\\s*[：:]')",
            "other_": "regexp_matches(text, '[\\x{0600}-\\x{06ff}\\x{0e00}-\\x{0e7f}\\x{0400}-\\x{04ff}\\x{ac00}-\\x{d7af}]')", "fragment": f"(length(tt) <= 3 OR regexp_matches(tt, '^(?:{full})$') OR (length(tt) <= 8 AND NOT {S.any_of('tt', pack.complete)}))",
            "store": f"({S.any_of('tt', pack.shop_names)} OR {S.any_of('tt', pack.operations)} OR {S.any_of('tt', pack.policies)})",
        },
        {"close_": f"5.0::DOUBLE * near + 0.35::DOUBLE * least(actions, 4) + {_points(S.any_of('text', pack.helpful), 0.6)} + {_points('strength >= 2 AND actions > 0', 0.4)}"},
    )


def positive(base: str, mode: Mode = scoring.NORMAL, pack: Pack = DEFAULT) -> str:
    """Adds `score` and `n_issues` of a good reply, from `turns`, `asked`, `reply`."""
    heavy = f"risky >= {2 if mode.strict else 3}"
    rejects = ["garbage", "leak", "other_", "blocked", *(["store"] if mode.generic else []), "low", "list_contains(turns, text)", "fragment"]
    if mode.sft:
        rejects += ["generic", "over_", S.any_of("tt", pack.hard_risk), S.any_of("tt", pack.refund_promise), "timely", "dated"]
    rejects.append("size < 6")
    rejects += ["kind IN ('courier_info', 'shipping_sla') AND timely"] if mode.sft else []
    rejects += ["unasked >= 3 AND size > 20"] if mode.strict else []
    rejects += ["pitch"] if mode.sft else []
    rejects += [f"clauses >= 6 AND (unasked > 0 OR {heavy})"] if mode.strict else []
    bands = "CASE " + " ".join(f"WHEN size <= {most} THEN {v!r}::DOUBLE" for most, v in (STRICT_BANDS if mode.strict else BANDS)) + f" ELSE {mode.of(-2.5, -4.0)!r}::DOUBLE END"
    many = ["clauses >= 4 AND size > 28", "clauses >= 6"] if mode.strict else ["clauses >= 6 AND size > 40"]
    terms = [bands, "close_", "CASE WHEN close_ < 0.6 THEN -3.0::DOUBLE WHEN close_ < 1.2 THEN -1.3::DOUBLE ELSE 0::DOUBLE END", _points("dated", mode.of(-2.5, -3.2)), _points("soft", mode.of(-1.8, -2.6))]
    terms += [_points(t, v) for t, v in zip(many, (-1.8, -2.6) if mode.strict else (-1.2,))]
    terms += [_points("generic", mode.of(-3.0, -4.0)), f"risky * {mode.of(-0.7, -1.0)!r}::DOUBLE", _points("over_", mode.of(-3.0, -4.0)), _points(f"contains(tt, '{TAIL}')", mode.of(-2.5, -3.0))]
    terms.append("CASE kind " + " ".join(f"WHEN '{n}' THEN {mode.of(*v)!r}::DOUBLE" for n, v in scoring._CATEGORY_TERMS.items()) + " ELSE 0::DOUBLE END")
    strictly = " WHEN unasked = 1 AND size > 24 THEN -1.2::DOUBLE" if mode.strict else ""
    terms.append(f"CASE WHEN unasked >= 2 THEN {mode.of(-2.2, -3.6)!r}::DOUBLE{strictly} ELSE 0::DOUBLE END")
    pushed = "CASE WHEN pitch AND unasked >= 1 THEN -2.6::DOUBLE WHEN pitch AND size > 28 THEN -1.2::DOUBLE ELSE 0::DOUBLE END" if mode.strict else _points("pitch AND unasked >= 1", -1.3)
    terms += [pushed, _points(S.any_of("tt", pack.helpful), 0.4)]
    minor = "(unasked >= 2 OR (unasked = 1 AND size > 24))" if mode.strict else "unasked >= 2"
    pushy = "pitch AND (unasked >= 1 OR size > 28)" if mode.strict else "pitch AND unasked >= 1"
    flags = ["dated", "soft", f"size > {mode.of(60, 40)}", "close_ < 1.2", *many, "generic", heavy, "over_", f"contains(tt, '{TAIL}')", minor, pushy]
    issues = "trims + " + " + ".join(f"({f})::INT" for f in flags)
    return steps(signs(trimmed(base, "reply"), pack), {"score": f"CASE WHEN {' OR '.join(f'({r})' for r in rejects)} THEN {REJECTED!r}::DOUBLE ELSE {' + '.join(terms)} END", "n_issues": issues})


def negative(base: str, mode: Mode = scoring.NORMAL, pack: Pack = DEFAULT) -> str:
    """Adds `score` and `n_issues` of a worse reply, from `turns`, `asked`, `reply`
    and the chosen text `best`."""
    terms = [("list_contains(turns, text)", -1.0), ("blocked", -1.0), ("near > 0.15", 0.8), ("generic", 0.5), ("soft", 0.5), ("dated", 0.3), ("unasked >= 1", mode.of(0.4, 0.6)), ("pitch", 0.4), ("fragment", -0.5)]
    reject = f"garbage OR leak OR other_ OR tt = {S.tight('best')} OR length(text) < 2 OR tt IN ({', '.join(map(S.q, pack.low_info))}) OR length(tt) <= 4"
    return steps(signs(trimmed(base, "reply"), pack), {"score": f"CASE WHEN {reject} THEN {REJECTED!r}::DOUBLE ELSE 1.0::DOUBLE + {' + '.join(_points(t, v) for t, v in terms)} END", "n_issues": "trims + list_contains(turns, text)::INT + blocked::INT + fragment::INT"})


def context_terms(pack: Pack = DEFAULT) -> dict[str, str]:
    """`c_score` and `c_issues` of `turns` and `asked`."""
    weak = f"(length({S.tight('asked')}) <= 3 OR regexp_matches({S.tight('asked')}, '^(?:{'|'.join(pack.weak_asked)})$'))"
    strength, distinct, n = S.question_strength("asked", pack), "(len(list_distinct(turns)) / len(turns)::DOUBLE)", "len(turns)"
    terms = [f"0.5::DOUBLE * least({n}, 8)", f"CASE WHEN {n} % 2 = 1 THEN 1.0::DOUBLE ELSE -0.8::DOUBLE END", f"CASE WHEN {strength} > 0 THEN 1.2::DOUBLE ELSE -1.8::DOUBLE END", _points(weak, -2.2), f"0.8::DOUBLE * {distinct}", _points(f"{distinct} < 0.6", -0.8)]
    return {"c_score": " + ".join(terms), "c_issues": f"({n} % 2 = 0)::INT + ({strength} = 0)::INT + {weak}::INT + ({distinct} < 0.6)::INT", "weak_question": f"{strength} = 0", "very_weak": weak}


def best_pairs() -> str:
    """CTEs up to `best`: one row per context with an accepted pair."""
    turns = f"list_transform(list_filter(coalesce(context, []), lambda t: {S.strip('t')} <> ''), lambda t: {S.clean_turn('t')})"
    base = steps("SELECT line_no, label, context, response FROM candidate", {"turns": turns, "reply": S.clean_turn("coalesce(response, '')")})
    base = steps(f"SELECT * FROM ({base}) WHERE len(turns) > 0 AND reply <> ''", {"asked": "turns[-1]"}, context_terms() | {"context_key": f"array_to_string(list_transform(turns, lambda t: {S.mask_key('t')}), ' || ')"})
    return f"""cands AS MATERIALIZED (SELECT line_no, label, turns, asked, reply, c_score, c_issues, weak_question, very_weak, context_key FROM ({base})),
    firsts AS (SELECT context_key, min(line_no) AS first_line, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM cands GROUP BY 1),
    pos AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY context_key ORDER BY total DESC, all_issues, length(text), line_no) AS place
      FROM (SELECT *, CASE WHEN score <= {REJECTED} THEN {REJECTED} ELSE c_score + score END AS total, c_issues + n_issues AS all_issues FROM ({positive('SELECT * FROM cands WHERE label = 1')})))
      WHERE place = 1 AND total >= 0 AND NOT very_weak AND NOT (weak_question AND total < 4.8)),
    negs AS MATERIALIZED (SELECT n.line_no, n.c_issues AS own, n.reply, p.context_key, p.turns, p.asked, p.text AS best FROM cands n JOIN pos p USING (context_key) WHERE n.label = 0),
    neg AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY context_key ORDER BY score DESC, own + n_issues, length(text), line_no) AS place FROM ({negative('SELECT * FROM negs')}) WHERE score > {REJECTED}) WHERE place = 1),
    best AS MATERIALIZED (SELECT p.context_key, p.turns AS context, p.text AS chosen, n.text AS rejected, p.kind AS category, p.total + greatest(0::DOUBLE, 0.15::DOUBLE * n.score) AS score, p.line_no AS pos_line_no, n.line_no AS neg_line_no, f.first_line, p.asked
      FROM pos p JOIN neg n USING (context_key) JOIN firsts f USING (context_key))"""


def _count(i: int, key: str) -> str:
    return f"len(list_filter(used, lambda e: e = '{i}:' || {key}))"


def _step(cte: str, rows: str, at: str, caps: list[str], keys: list[int], stop: int) -> str:
    """One row of a walk: `d` is the number of the first full key, or -1."""
    full = " ".join(f"WHEN {_count(i, f'k{i}')} >= {cap} THEN {n}" for n, (i, cap) in enumerate(zip(keys, caps)))
    taken = "list_concat(used, [" + ", ".join(f"'{i}:' || k{i}" for i in keys) + "])"
    return f"""SELECT {at}, rank, CASE WHEN d < 0 THEN {taken} ELSE used END, taken + (d < 0)::INT, d FROM (SELECT r.*, w.used, w.taken, CASE {full} ELSE -1 END AS d FROM {cte} w JOIN {rows} r ON r.{at} = w.{at} + 1 WHERE w.taken < {stop})"""


def two_passes(ranked: str, top_k: int, caps: dict[str, int]) -> str:
    """CTEs up to `picked (rank, pass_no)`, `one` and `two`, from `rank, k0..k3`."""
    own = "CASE r.k0 " + " ".join(f"WHEN '{n}' THEN {c}" for n, c in sorted(caps.items())) + f" ELSE {top_k} END"
    return f"""r AS MATERIALIZED ({ranked}),
    one AS (SELECT 0::BIGINT AS rank, 0::BIGINT AS r0, []::VARCHAR[] AS used, 0 AS taken, 9 AS d UNION ALL {_step('one', 'r', 'rank', [own, '5', '2', '1'], [0, 1, 2, 3], top_k)}),
    rest AS MATERIALIZED (SELECT r.*, row_number() OVER (ORDER BY r.rank) AS again FROM r JOIN one ON one.rank = r.rank WHERE one.d >= 0 AND one.rank > 0),
    two AS (SELECT 0::BIGINT AS again, 0::BIGINT AS rank, arg_max(used, rank) AS used, max(taken) AS taken, 9 AS d FROM one UNION ALL {_step('two', 'rest', 'again', ['6', '3', '2'], [1, 2, 3], top_k)}),
    picked AS (SELECT rank, 1 AS pass_no FROM one WHERE d < 0 UNION ALL SELECT rank, 2 FROM two WHERE d < 0)"""


def counters(names: list[str]) -> str:
    """`reason, n` from `one`, `two` and `picked`."""
    name = lambda column, which, end: f"[{', '.join(S.q(n + end) for n in which)}][{column} + 1]"
    return f"""SELECT {name('d', names, '')} AS reason, count(*) AS n FROM one WHERE d BETWEEN 0 AND 8 GROUP BY 1 UNION ALL SELECT 'selected_pass_' || pass_no, count(*) FROM picked GROUP BY 1
    UNION ALL SELECT {name('d', names[1:], '_relaxed')}, count(*) FROM two WHERE d BETWEEN 0 AND 8 GROUP BY 1"""


def repaired(pack: Pack = DEFAULT) -> str:
    """CTEs up to `repaired`: both sides of repair_group, where both can be saved."""
    words = lambda x: S.found(x, pack.actions)
    share = lambda a, b: f"(CASE WHEN least(len({a}), len({b})) > 0 THEN len(list_intersect({a}, {b})) / least(len({a}), len({b}))::DOUBLE ELSE 0::DOUBLE END)"
    about = "(" + " OR ".join(f"(kind = '{n}' AND {S.any_of('c', w)})" for n, w in pack.repair_categories) + ")"
    clauses = lambda x: f"list_filter(list_transform(regexp_split_to_array({S.repair_clean(x)}, '[，。！？；!?,;\\n]'), lambda e: {S.exact_edge('e')}), lambda e: e <> '')"
    low, bad = lambda x: S.low_info(x, pack), lambda x: f"({x} = '' OR {x} IN ('<ID>', '<PHONE>', '<NUM>', '<YEAR>') OR {S.any_of(x, pack.contact)})"
    times = ("几", "多久", "什么时候", "发货", "到货")
    good = f"""{_points(low('x'), -5.0)} + {_points(S.any_of('c', pack.contact), -12.0)} + {_points("regexp_matches(x, '<(ID|PHONE|NUM|YEAR)>')", -7.0)} + {_points(S.any_of('c', pack.store), -3.5)} + {_points(f"{S.any_of('c', pack.promise)} AND NOT (timely OR kind = 'shipping')", -2.0)}
      + {_points(f"{S.any_of('c', pack.risky)} AND kind NOT IN ('refund', 'shipping', 'address')", -2.0)} + 8.0::DOUBLE * {share('qw', words('c'))} + {_points(S.any_of('c', pack.actions), 2.0)} + {_points(about, 2.0)}
      + CASE WHEN length(x) BETWEEN 6 AND 26 THEN 2.0::DOUBLE WHEN length(x) <= 40 THEN 1.0::DOUBLE ELSE -1.5::DOUBLE END"""
    wrong = f"""{_points(low('x'), -5.0)} + {_points(S.any_of('c', pack.contact), 4.5)} + {_points(S.any_of('c', pack.risky + pack.promise), 3.0)} + 6.0::DOUBLE * {share('qw', words('c'))} + {_points(about, 1.5)}
      + CASE WHEN length(x) < 6 THEN -1.0::DOUBLE WHEN length(x) <= 28 THEN 1.0::DOUBLE ELSE 0::DOUBLE END"""
    pick = "CASE kind " + " ".join(f"WHEN {S.q(n)} THEN [{', '.join(map(S.q, t))}][h % {len(t)} + 1]" for n, t in sorted(pack.negatives.items())) + " END"
    each = lambda name, source, score: f"""{name} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY repair_id ORDER BY s DESC, length(x), i) AS place FROM (SELECT *, {score} AS s FROM
      (SELECT repair_id, kind, qw, timely, i, x, {S.tight('x')} AS c FROM (SELECT *, unnest({source}) AS x, generate_subscripts({source}, 1) AS i FROM src) QUALIFY row_number() OVER (PARTITION BY repair_id, {S.tight('x')} ORDER BY i) = 1)))"""  # noqa: E731
    near = share(words("qk"), words("t"))
    return f"""src0 AS MATERIALIZED (SELECT repair_id, context, chosen, rejected, score, source, issues, {S.repair_clean('context[-1]')} AS asked FROM repair_group WHERE len(context) > 0),
    src1 AS MATERIALIZED (SELECT *, {S.compact('asked')} AS qk, {S.compact('chosen')} AS whole, {clauses('chosen')} AS good_, {clauses('rejected')} AS bad_, {S.repair_clean('rejected')} AS all_bad FROM src0),
    src AS MATERIALIZED (SELECT *, {S.first_category(pack.repair_categories, lambda w: S.any_of('qk', w))} AS kind, {words('qk')} AS qw, {S.any_of('qk', times)} AS timely, ('0x' || substr(md5(qk), 1, 8))::BIGINT AS h FROM src1),
    {each('g', 'good_', good)},
    {each('b', 'bad_', wrong)},
    g1 AS (SELECT repair_id, x AS x1, s AS s1 FROM g WHERE place = 1),
    g2 AS (SELECT repair_id, arg_min(x, place) AS x2 FROM g JOIN g1 USING (repair_id) WHERE place > 1 AND s > 0 AND s1 > 0 AND length(x1) + length(x) <= 34 GROUP BY 1),
    kept AS MATERIALIZED (SELECT src.*, coalesce(s1, 0::DOUBLE) AS s1, coalesce(s1 >= 0, false) AS any_, {S.without_masks("concat_ws('，', x1, x2)")} AS text FROM src LEFT JOIN g1 USING (repair_id) LEFT JOIN g2 USING (repair_id)),
    pos AS MATERIALIZED (SELECT *, {S.compact('text')} AS best, s1 + length(text) / 10.0::DOUBLE AS pos_score,
      list_filter([CASE WHEN {S.tight('text')} <> whole THEN 'trimmed_positive' END, CASE WHEN {S.any_of('whole', pack.store)} THEN 'store_specific_positive' END, CASE WHEN {S.any_of('whole', pack.promise)} THEN 'time_promise_positive' END], lambda e: e IS NOT NULL) AS pos_issues
      FROM kept WHERE any_ AND NOT {low('text')} AND NOT {bad(S.compact('text'))}),
    n1 AS MATERIALIZED (SELECT pos.*, coalesce(b.s > 0, false) AS found_, CASE WHEN b.s > 0 THEN b.x ELSE all_bad END AS part FROM pos LEFT JOIN b ON b.repair_id = pos.repair_id AND b.place = 1),
    n2 AS MATERIALIZED (SELECT *, {S.compact('part')} AS t FROM n1),
    n3 AS MATERIALIZED (SELECT *, ({low('part')} OR t = '' OR t IN ('<ID>', '<PHONE>', '<NUM>', '<YEAR>') OR (NOT {near} >= 0.12 AND NOT {S.any_of('t', pack.contact + pack.risky)}) OR length(t) <= 6 OR t = best) AS again FROM n2),
    n4 AS MATERIALIZED (SELECT * EXCLUDE (t), CASE WHEN again THEN {pick} ELSE part END AS worse FROM n3),
    n5 AS MATERIALIZED (SELECT *, {S.compact('worse')} AS t FROM n4),
    repaired AS MATERIALIZED (SELECT *, coalesce(score, 0) + pos_score + (6.0::DOUBLE * {near} + {_points(S.any_of('t', pack.contact), 4.0)} + {_points(S.any_of('t', pack.risky + pack.promise), 3.0)} + {_points(S.any_of('t', pack.actions), 1.0)} + {_points('again', 2.0)}) AS repair_score,
      list_concat(coalesce(issues, []), pos_issues, CASE WHEN again THEN ['rewritten_negative'] WHEN found_ THEN ['trimmed_negative'] ELSE [] END) AS all_issues FROM n5 WHERE NOT (t = best OR {low('worse')} OR length(t) < 6))"""


def repaired_selection(top_k: int) -> str:
    """The repair job's selection: `repair_id, rank, pass_no, repair_category`."""
    own = "CASE r.k2 " + " ".join(f"WHEN '{n}' THEN {int(top_k * s)}" for n, s in sorted(quota.REPAIR_SHARES.items())) + f" ELSE {top_k} END"
    return f"""WITH RECURSIVE {repaired()},
    r AS MATERIALIZED (SELECT repair_id, row_number() OVER (ORDER BY repair_score DESC, (source IS NOT DISTINCT FROM 'manual_round2') DESC, length(best), repair_id) AS rank, {S.repair_key('text')} AS k0, {S.repair_key('context[-1]')} AS k1, kind AS k2,
      array_to_string(list_transform(context, lambda t: {S.repair_clean('t')}), chr(10)) || chr(1) || {S.repair_key('text')} || chr(1) || {S.repair_key('worse')} AS pair FROM repaired),
    one AS (SELECT 0::BIGINT AS rank, 0::BIGINT AS r0, []::VARCHAR[] AS used, 0 AS taken, 9 AS d UNION ALL {_step('one', 'r', 'rank', ['3', '2', own], [0, 1, 2], top_k)}),
    fill AS (SELECT rank FROM (SELECT r.rank, r.pair, row_number() OVER (PARTITION BY r.pair ORDER BY r.rank) AS n FROM r) f WHERE n = 1 AND pair NOT IN (SELECT pair FROM r JOIN one USING (rank) WHERE d < 0) ORDER BY rank LIMIT greatest(0, {top_k} - (SELECT max(taken) FROM one))),
    picked AS (SELECT rank, 1 AS pass_no FROM one WHERE d < 0 UNION ALL SELECT rank, 2 FROM fill)
    SELECT repair_id, rank, pass_no, k2 AS repair_category FROM picked JOIN r USING (rank)"""
