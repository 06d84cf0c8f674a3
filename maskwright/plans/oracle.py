"""Pieces of SQL for checking the masking queries with another engine."""

from __future__ import annotations

from maskwright import fixed_values as fixed

S = r"\t\n\f\r "


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def entropy_sql(v: str) -> str:
    share = f"((length({v}) - length(replace({v}, c, '')))::DOUBLE / strlen({v}))"
    return (
        f"coalesce(-list_sum(list_transform(list_sort(list_distinct(regexp_extract_all({v}, '(?s).'))), "
        f"lambda c: {share} * log2({share}))), 0.0)"
    )


def jwt_sql(v: str) -> str:
    part = f"string_split({v}, '.')"
    return f"(len({part}) = 3 AND length({part}[1]) % 4 <> 1 AND length({part}[2]) % 4 <> 1)"


def _assigned(name: str) -> str:
    return rf"(?i:{name})[\"']?[{S}]*[=:][{S}]*[\"']?"


ALPHA_NUM = r"regexp_matches(value, '\p{Nd}') AND regexp_matches(value, '\p{L}')"

# type -> (pattern, score, condition on value, prefix of the match that is not part of the value)
RULES: dict[str, tuple[str, float, str, str | None]] = {
    "email": (fixed.EMAIL_PATTERN, fixed.EMAIL_SCORE, "true", None),
    "phone": (fixed.PHONE_PATTERN, fixed.PHONE_SCORE, "true", None),
    "api_key": (
        fixed.TOKEN_PATTERN,
        fixed.API_KEY_SCORE,
        f"{ALPHA_NUM} AND {entropy_sql('value')} >= {fixed.API_KEY_MIN_ENTROPY}",
        None,
    ),
    "jwt": (fixed.JWT_PATTERN, fixed.JWT_SCORE, jwt_sql("value"), None),
    "aws_access_key": (r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", 0.99, "true", None),
    "aws_secret_key": (
        _assigned("aws_secret_access_key") + "[A-Za-z0-9/+=]{40,}",
        0.99,
        "length(value) = 40",
        "^" + _assigned("aws_secret_access_key"),
    ),
    "aws_session_token": (
        _assigned("aws_session_token") + "[A-Za-z0-9/+=]{100,}",
        0.99,
        "true",
        "^" + _assigned("aws_session_token"),
    ),
    "gcp_api_key": (r"AIza[0-9A-Za-z_\-]{35}", 0.99, "true", None),
    "gcp_service_account": (rf'"type"[{S}]*:[{S}]*"service_account"', 0.99, "true", None),
    "azure_connection_string": (
        "DefaultEndpointsProtocol=https?;AccountName=[^;]+;AccountKey=[A-Za-z0-9+/=]+",
        0.99,
        "true",
        None,
    ),
    "azure_sas_token": (
        rf"sv=\d{{4}}-\d{{2}}-\d{{2}}&[^{S}\"'<>]*sig=[A-Za-z0-9%+/=]+",
        0.99,
        "true",
        None,
    ),
    "private_key": (
        r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----)?",
        0.99,
        "true",
        None,
    ),
    "db_url": (
        r"(?i)(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp)://"
        rf"[^{S}:/@\"']*:[^{S}@\"']+@[^{S}\"'<>]+",
        0.99,
        "true",
        None,
    ),
    "high_entropy": (
        r"[A-Za-z0-9+/=_\-]{20,}",
        0.7,
        f"{ALPHA_NUM} AND {entropy_sql('value')} >= 4.5",
        None,
    ),
    "hex_secret": (r"\b[0-9a-fA-F]{32,}\b", 0.75, f"{entropy_sql('value')} >= 3.0", None),
}
ALL_TYPES = list(RULES)


def spans_sql(source: str, key: str, types: list[str] | None = None, min_confidence: float = 0.0) -> str:
    """CTEs up to `spans` (key, type, value, s, e, score, src, ord) of the texts of `source`."""
    ctes = [f"src AS ({source})"]
    parts = []
    for order, name in enumerate(types or ALL_TYPES):
        pattern, score, condition, lead = RULES[name]
        if score < min_confidence:
            continue
        value = f"regexp_replace(hit, {q(lead)}, '')" if lead else "hit"
        ctes.append(
            f"""hit_{name} AS (
  SELECT {key}, value, e - length(value) AS s, e FROM (
    SELECT {key}, {value} AS value, sum(length(gap) + length(hit)) OVER (PARTITION BY {key} ORDER BY i) AS e
    FROM (SELECT {key}, unnest(g[1:len(m)]) AS gap, unnest(m) AS hit, unnest(range(len(m))) AS i FROM (
      SELECT {key}, string_split_regex(text, {q(pattern)}) AS g, regexp_extract_all(text, {q(pattern)}) AS m FROM src)))
  WHERE {condition})"""
        )
        parts.append(
            f"SELECT {key}, '{name}' AS type, value, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, "
            f"CAST({score} AS DOUBLE) AS score, 'regex' AS src, {order} AS ord FROM hit_{name}"
        )
    ctes.append("spans AS (" + " UNION ALL ".join(parts) + ")")
    return ",\n".join(ctes)


def chosen_sql(key: str, overlap: str = "first_longest", limit: int = 0, spans: str = "spans") -> str:
    """CTE `chosen`: the spans left after overlaps are resolved."""
    element = (
        "{'s': s, 'e': e, 'score': score, 'src': src, "
        "'k': [{'type': type, 'value': value, 's': s, 'e': e, 'score': score, 'src': src}]}"
    )
    take = "{'s': x.s, 'e': x.e, 'score': x.score, 'src': x.src, 'k': "
    if overlap == "prefer":
        order = "s, e DESC, score DESC, ord"
        better = (
            "CASE WHEN x.src = 'regex' AND a.src <> 'regex' THEN true WHEN x.src <> 'regex' AND a.src = 'regex' "
            "THEN false ELSE x.score > a.score END"
        )
        fold = (
            f"CASE WHEN x.s >= a.e THEN {take} list_concat(a.k, x.k)}} "
            f"WHEN {better} THEN {take} list_concat(a.k[1:len(a.k) - 1], x.k)}} ELSE a END"
        )
    else:
        order = "s, e DESC, ord"
        fold = f"CASE WHEN x.s >= a.e THEN {take} list_concat(a.k, x.k)}} ELSE a END"
    kept = f"list_reduce(list({element} ORDER BY {order}), lambda a, x: {fold}).k"
    cut = f"({kept})[1:{limit}]" if limit else kept
    return f"""chosen AS (
  SELECT {key}, c.type AS type, c.value AS value, c.s AS s, c.e AS e, c.score AS score, c.src AS src
  FROM (SELECT {key}, unnest(k) AS c FROM (SELECT {key}, {cut} AS k FROM {spans} GROUP BY {key})))"""


def masked_sql(key: str) -> str:
    """CTEs `placed` and `masked` (key, masked, n_items) from `chosen` and `src`."""
    return f"""placed AS (
  SELECT *, '[' || upper(type) || '_' || dense_rank() OVER (PARTITION BY {key}, upper(type) ORDER BY first) || ']'
    AS placeholder
  FROM (SELECT *, min(s) OVER (PARTITION BY {key}, upper(type), value) AS first FROM chosen)),
masked AS (
  SELECT src.{key} AS {key}, coalesce(p.head || substr(src.text, p.last + 1), src.text) AS masked,
    coalesce(p.n_items, 0) AS n_items
  FROM src LEFT JOIN (
    SELECT {key}, string_agg(piece, '' ORDER BY s) AS head, max(e) AS last, count(DISTINCT placeholder) AS n_items
    FROM (
      SELECT placed.{key} AS {key}, s, e, placeholder,
        substr(text, coalesce(lag(e) OVER w, 0) + 1, s - coalesce(lag(e) OVER w, 0)) || placeholder AS piece
      FROM placed JOIN src ON src.{key} = placed.{key}
      WINDOW w AS (PARTITION BY placed.{key} ORDER BY s))
    GROUP BY {key}) p ON p.{key} = src.{key})"""


def sanitize_sql(
    source: str,
    key: str,
    types: list[str] | None = None,
    min_confidence: float = 0.0,
    overlap: str = "first_longest",
    limit: int = 0,
) -> str:
    """All of the above, to be followed by a SELECT."""
    return "WITH " + ",\n".join(
        [spans_sql(source, key, types, min_confidence), chosen_sql(key, overlap, limit), masked_sql(key)]
    )
