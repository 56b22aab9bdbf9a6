"""SQL for DuckDB of string predicates and scores, written apart from the Spark expressions they are held against; the rule
tables are the same data."""

from __future__ import annotations

from leakloom.functions import rules as R


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_in(t: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({t}, {text(w)})" for w in words) + ")"


def one_of(t: str, words: list[str]) -> str:
    return f"{t} IN (" + ", ".join(map(text, words)) + ")"


def entropy(t: str) -> str:
    return f"(CASE WHEN length({t}) > 0 THEN list_aggregate(string_split(left({t}, 10000), ''), 'entropy') ELSE 0.0 END)"


def repetitive(t: str) -> str:
    runs = [s[i : i + 3] for s in ("0123456789", "9876543210", "abcdefghijklmnopqrstuvwxyz") for i in range(len(s) - 2)]
    three = f"len(list_filter(range(1, CAST(greatest(length({t}) - 2, 1) AS BIGINT)), lambda i: substr({t}, i, 1) = substr({t}, i + 1, 1) AND substr({t}, i, 1) = substr({t}, i + 2, 1))) > 0"
    tiled = f"len(list_filter(range(3, CAST(least(length({t}) // 2 + 1, 20) AS BIGINT)), lambda k: {t} = left(repeat(left({t}, k), CAST(ceil(length({t}) / k) AS BIGINT)), length({t})))) > 0"
    return f"coalesce(length({t}) >= 6 AND ({three} OR {tiled} OR (length({t}) BETWEEN 6 AND 7 AND {any_in(f'lower({t})', runs)})), false)"


def encoded(t: str, least: int = 32, least64: int = 32) -> str:
    s = f"trim({t})"
    uuid = f"(length({s}) = 36 AND length({s}) - length(replace({s}, '-', '')) = 4)"
    hexed = f"(regexp_full_match({s}, '[0-9a-fA-F]+') AND length({s}) >= {least})"
    dense = f"(length({s}) > 200 AND NOT contains({s}, ' ') AND length(regexp_replace({s}, '[^\\p{{L}}\\p{{N}}]', '', 'g')) / greatest(length({s}), 1) > 0.95)"
    mixed = f"((regexp_matches({s}, '[A-Z]') AND regexp_matches({s}, '[a-z]') AND regexp_matches({s}, '[0-9]')) OR suffix({s}, '='))"
    return f"coalesce({uuid} OR {hexed} OR {dense} OR (length({s}) >= {least64} AND regexp_full_match({s}, '[A-Za-z0-9+/]+={{0,2}}') AND {mixed}), false)"


def base64(t: str) -> str:
    return f"coalesce(length({t}) >= 20 AND NOT regexp_matches(lower({t}), '^(eyj|ghp_|gho_|ghu_|ghs_|akia)') AND regexp_full_match({t}, '[A-Za-z0-9+/]{{20,}}={{0,2}}'), false)"


def placeholder(t: str) -> str:
    s = f"trim(lower({t}))"
    shape = "^(" + "|".join(R.PLACEHOLDER_PREFIXES) + ")[_-]|[_-](" + "|".join(R.PLACEHOLDER_SUFFIXES) + r")$|^<.*>$|^\[.*\]$|^\{.*\}$|^xxx+$|^\.{3,}$|^\*{3,}$"
    return f"coalesce({one_of(s, R.PLACEHOLDERS)} OR regexp_matches({s}, '{shape}'), false)"


def example(t: str) -> str:
    s = f"trim(lower({t}))"
    return "(" + " OR ".join(f"contains({s}, {text(e)}) OR (length({s}) > 10 AND contains({text(e)}, {s}))" for e in R.EXAMPLE_SECRETS) + ")"


def structured(t: str) -> str:
    s = f"trim({t})"
    prefix = f"regexp_matches({s}, '^(sk_|pk_|rk_|gh[opsu]_|xox|AKIA|ABIA|ACCA|ASIA|eyJ|bearer |Bearer |(api|key|token|secret)[_-]|-----BEGIN)')"
    pair = f"regexp_matches({s}, '^[\\p{{L}}\\p{{N}}_-]+\\s*[:=]\\s*.+$')"
    parts = [f"(len(string_split({s}, '{x}')) BETWEEN 2 AND 6 AND len(list_filter(string_split({s}, '{x}'), lambda x: length(x) < 2)) = 0)" for x in "-_."]
    return f"coalesce(length({t}) >= 8 AND ({prefix} OR {pair} OR {' OR '.join(parts)}), false)"


def random_with(t: str, words: list[str]) -> str:
    letters, upper = (f"length(regexp_replace({t}, '[^\\p{{{k}}}]', '', 'g'))" for k in ("L", "Lu"))
    inside = " OR ".join(f"(position({text(w)} IN lower({t})) > 1 AND regexp_matches(substr({t}, position({text(w)} IN lower({t})) - 1, 1), '[\\p{{L}}\\p{{N}}]') AND regexp_matches(substr({t}, position({text(w)} IN lower({t})) + {len(w)}, 1), '[\\p{{L}}\\p{{N}}]'))" for w in words if len(w) > 2)
    return f"(length({t}) >= 25 AND NOT {structured(t)} AND {letters} >= 10 AND {upper} / greatest({letters}, 1) > 0.15 AND {upper} / greatest({letters}, 1) < 0.85 AND ({inside or 'false'}))"


def path_part(p: str, parts: list[str]) -> str:
    low = f"lower({p})"
    long, short = [x for x in parts if len(x) > 5], "(" + "|".join(x.replace(".", r"\.") for x in parts if len(x) <= 5) + ")"
    return f"({any_in(low, long)} OR regexp_matches({low}, '[/\\\\]{short}[/\\\\.]|^{short}[/\\\\.]|[/\\\\]{short}$'))"


def binary(p: str) -> str:
    return f"regexp_matches(lower({p}), '\\.({'|'.join(R.BINARY_ENDINGS)})$')"


def mock(p: str) -> str:
    return path_part(p, R.MOCK_PATHS)


def false_path(p: str) -> str:
    name = f"lower(regexp_extract({p}, '[^/\\\\]*$'))"
    return f"({path_part(p, R.FALSE_PATHS)} OR {mock(p)} OR regexp_matches({name}, '^(test_|example|sample|demo|mock|fixture)|_test\\.|\\.test\\.|\\.spec\\.|_mock\\.|_stub\\.'))"


def framework(p: str) -> str:
    return f"regexp_matches(lower({p}), '[/\\\\]({'|'.join(R.FRAMEWORKS)})[/\\\\]')"


def _class(rule: str, match: str, path: str) -> list[tuple[str, str, str]]:
    """(condition, type, weight) in order."""
    t, m = f"lower(concat_ws(' ', {rule}, {match}, {path}))", f"lower({match})"
    factor = f"(CASE WHEN regexp_matches(lower({path}), '/(tests?|spec|examples?|sample|demo|fixture|mock)/') THEN 0.3 ELSE 1.0 END)"
    marks = "test_ test- _test -test example_ example- _example sample_ demo_ demo- dummy_ fake_ mock_ placeholder".split()
    out = [(f"{any_in(t, marks)} AND {any_in(t, 'password pass pwd secret key token'.split())}", "dummy_password", "0.05")]
    out += [(f"contains({m}, 'akia') OR {any_in(t, ['aws_access', 'aws_secret'])}", "aws_key", f"0.95 * {factor}"), (f"regexp_matches({m}, 'gh[pous]_')", "github_token", f"0.95 * {factor}"), (f"starts_with({m}, 'eyj') OR contains(lower({rule}), 'jwt')", "jwt_token", f"0.8 * {factor}")]
    for k, (words, w) in R.SECRET_TYPES.items():
        out.append((any_in(t, words), k, f"least({w} * {factor}, 0.1)" if k in ("test_password", "dev_password", "dummy_password") else f"{w} * {factor}"))
    return [*out, (base64(match), "base64_blob", f"0.1 * {factor}"), ("true", "unknown", f"0.3 * {factor}")]


def secret_type(rule: str, match: str, path: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{k}'" for c, k, _ in _class(rule, match, path)) + " END"


def secret_weight(rule: str, match: str, path: str) -> str:
    return "CAST(CASE " + " ".join(f"WHEN {c} THEN {w}" for c, _, w in _class(rule, match, path)) + " END AS DOUBLE)"


def least_entropy(kind: str) -> str:
    return f"(CASE {kind} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in R.LEAST_ENTROPY.items()) + f" ELSE {R.LEAST_ENTROPY_ELSE} END)::DOUBLE"


def entropy_score(e: str, kind: str) -> str:
    m = least_entropy(kind)
    return f"(CASE WHEN {e} < {m} THEN {e} / {m} * 0.5 WHEN {e} < {m} + 1 THEN 0.5 + 0.3 * ({e} - {m}) ELSE least(1.0, 0.8 + 0.1 * ({e} - {m} - 1)) END)"


def format_score(m: str, kind: str) -> str:
    n, low, letter, digit = f"length({m})", f"lower({m})", f"regexp_matches({m}, '\\p{{L}}')", f"regexp_matches({m}, '[0-9]')"
    key = f"CASE WHEN {n} >= 32 AND {letter} AND {digit} THEN 0.85 WHEN {n} >= 20 AND {letter} AND {digit} THEN 0.7 WHEN {n} >= 16 AND ({letter} OR {digit}) THEN 0.55 WHEN {n} < 12 THEN 0.2 ELSE 0.4 END"
    word = f"CASE WHEN {one_of(low, R.COMMON_PASSWORDS)} THEN 0.25 WHEN {n} < 6 THEN 0.15 WHEN {n} >= 12 AND regexp_matches({m}, '\\p{{Lu}}') AND {digit} THEN 0.75 WHEN {n} >= 8 THEN 0.5 ELSE 0.3 END"
    jwt = f"CASE WHEN len(string_split({m}, '.')) = 3 AND len(list_filter(string_split({m}, '.'), lambda x: length(x) <= 10)) = 0 THEN 0.9 WHEN starts_with({low}, 'eyj') THEN 0.8 ELSE 0.4 END"
    aws = f"CASE WHEN regexp_full_match({m}, 'AKIA[A-Z0-9]{{16}}') THEN 0.95 WHEN {n} = 40 AND regexp_full_match({m}, '[A-Za-z0-9+/]+') THEN 0.85 ELSE 0.4 END"
    hub = f"CASE WHEN regexp_full_match({m}, 'gh[pous]_[A-Za-z0-9]{{36,}}') THEN 0.95 WHEN regexp_matches({m}, '^gh[pous]_') THEN 0.8 ELSE 0.3 END"
    pem = f"CASE WHEN contains({m}, '-----BEGIN') AND contains({m}, '-----END') THEN 0.95 WHEN {n} > 200 THEN 0.7 ELSE 0.3 END"
    strong = f"CASE WHEN {one_of(low, R.PLACEHOLDERS)} THEN 0.05 WHEN {n} >= 16 THEN 0.8 WHEN {n} >= 10 THEN 0.6 ELSE 0.3 END"
    cert = f"CASE WHEN contains({m}, '-----BEGIN CERTIFICATE') THEN 0.9 WHEN {n} > 500 THEN 0.7 ELSE 0.4 END"
    by = [(["private_key"], pem), (["aws_key"], aws), (["github_token"], hub), (["jwt_token"], jwt), (["api_key", "access_token", "secret_key"], key), (["password"], word), (["database_password", "prod_password", "admin_password"], strong), (["test_password", "dev_password", "dummy_password"], "0.1"), (["certificate"], cert)]
    return f"(CASE WHEN {n} = 0 THEN 0.1 " + " ".join(f"WHEN {one_of(kind, ks)} THEN {e}" for ks, e in by) + " ELSE 0.5 END)::DOUBLE"


def validity(m: str, path: str, kind: str, cred: str, company: list[str] | None = None) -> str:
    when = lambda c, w: f"(CASE WHEN {c} THEN {w} ELSE 0 END)"
    template, local = any_in(f"lower({path})", R.TEMPLATE_MARKS), any_in(f"lower({m})", R.LOCAL_HOSTS)
    s = structured(m)
    penalty = " + ".join([when(binary(path), 0.6), when(example(m), 0.5), when(placeholder(m), 0.5), when(template, 0.3), when(mock(path), 0.15), when(local, 0.1), when(f"{encoded(m)} AND NOT {s}", 0.3), when(repetitive(m), 0.3), when(false_path(path), 0.2), when(random_with(m, company or []), 0.2)])
    base = f"(0.35 * {entropy_score(entropy(m), kind)} + 0.35 * {format_score(m, kind)} + 0.2 * {cred} + 0.05 + {when(s, 0.2)})"
    n = f"length({m})"
    share = lambda k: f"length(regexp_replace({m}, '[^\\p{{{k}}}]', '', 'g')) / greatest({n}, 1)"
    short = f"(CASE WHEN {n} < 6 THEN 0.3 WHEN {n} < 10 AND regexp_full_match({m}, '[\\p{{L}}\\p{{N}}]+') THEN 0.6 ELSE 1 END)"
    flat = f"(CASE WHEN len(list_distinct(string_split({m}, ''))) <= 2 AND {n} > 3 THEN 0.1 ELSE 1 END)"
    noise = f"(CASE WHEN {n} > 50 AND NOT {s} AND {share('Lu')} > 0.2 AND {share('Lu')} < 0.8 AND {share('Ll')} > 0.2 AND {share('Ll')} < 0.8 THEN 0.4 ELSE 1 END)"
    return f"greatest(0, least(1, CAST({base} * greatest(0.3, 1 - least({penalty}, 0.7)) * {short} * {flat} * {noise} AS DOUBLE)))"


def context(path: str, match: str, before: str = "''", after: str = "''") -> str:
    t, p = f"lower(concat_ws(' ', {path}, {before}, {match}, {after}))", f"lower({path})"
    when = lambda c, w: f"(CASE WHEN {c} THEN {w} ELSE 0 END)"
    terms = [when(f"contains({t}, '{k}')", w) for k, w in R.CONTEXT_WEIGHTS.items()]
    terms += [when(false_path(path), -0.4), when(any_in(p, ["config", "properties", ".env", "secret", "credential"]), 0.2), when(any_in(p, [".prod", "production", "live", "deploy"]), 0.25), when(any_in(p, R.DOC_MARKS), -0.3)]
    return "CAST(" + " + ".join([*terms, when(f"regexp_matches({t}, '(#|//|/\\*|\\*/|<!--|-->|todo:|fixme:)\\s*example')", -0.15)]) + " AS DOUBLE)"
