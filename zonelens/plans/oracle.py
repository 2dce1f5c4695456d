"""DuckDB twins of the registered queries (the independent correctness oracle).

Each twin recomputes its query from the raw tables with plain SQL: the DNS
stand-in view, then per-row name features (suffix rules as a VALUES table with
the same longest-match / wildcard / exception logic, entropy through list
lambdas), then the aggregate. Doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from zonelens.config import ENTROPY_BINS, HIGH_ENTROPY_THRESHOLD, HOST_ENTROPY_MAX, INTENT_THRESHOLDS, TOP_N
from zonelens.operators.suffix import IPV4_RE
from zonelens.sources.dims import SEED_SUFFIX_RULES, parse_suffix_rule
from zonelens.sources.tables import STANDIN_SQL

_RULES = [parse_suffix_rule(r) for r in SEED_SUFFIX_RULES.split()]
DEPTH = max(len(s.split(".")) for s, _, _ in _RULES) + 1


def _b(x: bool) -> str:
    return "true" if x else "false"


def _forms(rule: str) -> list[str]:
    """A rule and its ASCII form."""
    wire = ".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in rule.split("."))
    return sorted({rule, wire})


def rules_cte() -> str:
    vals = ", ".join(f"('{form}', {_b(not w and not e)}, {_b(w)}, {_b(e)})" for s, w, e in _RULES for form in _forms(s))
    return (
        "rules AS (SELECT rule, bool_or(exact) AS exact, bool_or(wild) AS wild, bool_or(exc) AS exc "
        f"FROM (VALUES {vals}) t(rule, exact, wild, exc) GROUP BY rule)"
    )


def host_sql(x: str) -> str:
    h = f"lower(trim({x}))"
    h = f"regexp_replace({h}, '^[a-z][a-z0-9+.-]*://', '')"
    h = f"regexp_extract({h}, '^([^/?#]*)', 1)"
    h = f"regexp_replace({h}, '^[^@]*@', '')"
    h = f"regexp_replace({h}, ':[0-9]*$', '')"
    h = f"regexp_replace({h}, '\\.$', '')"
    return f"nullif({h}, '')"


def clean_sql(x: str) -> str:
    return f"nullif(regexp_replace(lower({x}), '[^a-z0-9-]', '', 'g'), '')"


def entropy_sql(c: str) -> str:
    """Entropy of ``c`` (NULL stays NULL); ``c`` must be non-empty when not NULL."""
    p = f"((length({c}) - length(replace({c}, ch, ''))) / length({c}))"
    return f"(0.0 - list_sum(list_transform(list_sort(list_distinct(string_split({c}, ''))), lambda ch: {p} * log2({p}))))"


def bin_sql(e: str) -> str:
    parts = []
    for label, lo, hi in ENTROPY_BINS:
        cond = f"{e} >= {lo}" + ("" if hi == float("inf") else f" AND {e} < {hi}")
        parts.append(f"WHEN {cond} THEN '{label}'")
    return "CASE " + " ".join(parts) + " END"


def domain_parts_ctes(src: str, name: str) -> list[str]:
    """CTEs turning relation ``src`` (with column ``name``) into ``dp`` with the domain parts added."""
    cands = ", ".join(
        f"CASE WHEN n >= {j} THEN array_to_string(labels[n-{j}+1:n], '.') END AS c{j}" for j in range(1, DEPTH + 1)
    )
    joins = " ".join(f"LEFT JOIN rules r{j} ON r{j}.rule = c.c{j}" for j in range(1, DEPTH + 1))
    flags = ", ".join(
        f"r{j}.exact AS e{j}, r{j}.wild AS w{j}, r{j}.exc AS x{j}" for j in range(1, DEPTH + 1)
    )
    exc = ", ".join(f"CASE WHEN x{j} THEN {j - 1} END" for j in range(1, DEPTH + 1))
    rule = ", ".join(
        [f"CASE WHEN e{j} THEN {j} END" for j in range(1, DEPTH + 1)]
        + [f"CASE WHEN w{j} AND n > {j} THEN {j + 1} END" for j in range(1, DEPTH + 1)]
    )
    return [
        rules_cte(),
        f"dp_h AS (SELECT *, {host_sql(name)} AS h FROM {src})",
        "dp_l AS (SELECT *, string_split(h, '.') AS labels, len(string_split(h, '.')) AS n FROM dp_h)",
        f"dp_c AS (SELECT *, {cands} FROM dp_l)",
        f"dp_j AS (SELECT c.*, {flags} FROM dp_c c {joins})",
        f"dp_s AS (SELECT *, coalesce(greatest({exc}, NULL::INTEGER), greatest({rule}), 0) AS slen, "
        f"coalesce(regexp_matches(h, '{IPV4_RE}'), false) AS is_ip FROM dp_j)",
        "dp_p AS (SELECT *, "
        "CASE WHEN NOT is_ip AND slen > 0 THEN array_to_string(labels[n-slen+1:n], '.') END AS suffix, "
        "CASE WHEN is_ip THEN h WHEN h IS NOT NULL AND n - slen >= 1 THEN nullif(labels[n-slen], '') END AS domain, "
        "CASE WHEN NOT is_ip AND h IS NOT NULL AND n - slen >= 2 "
        "THEN nullif(array_to_string(labels[1:n-slen-1], '.'), '') END AS subdomain FROM dp_s)",
        "dp AS (SELECT *, CASE WHEN domain IS NOT NULL AND suffix IS NOT NULL THEN domain || '.' || suffix END AS root_domain, "
        "CAST(CASE WHEN subdomain IS NOT NULL THEN len(string_split(subdomain, '.')) ELSE 0 END AS INTEGER) "
        "AS subdomain_label_count FROM dp_p)",
    ]


def enriched_ctes(source: list[str] | None = None, more: str = "", relation: str = "dns") -> list[str]:
    """CTEs ending in ``enr``: rows with a qname (of the stand-in, or of ``relation`` at the end of
    ``source``) plus every gold name feature. ``more``: further columns, each with a comma before it."""
    ctes = source or [f"dns AS ({STANDIN_SQL})"]
    ctes = ctes + [
        f"b AS (SELECT tenant, event_date, event_ts, id, qr, rcode, qtype, src_ip{more}, "
        "regexp_replace(qname, '\\.$', '') AS qname, lower(trim(qname)) AS name "
        f"FROM {relation} WHERE qname IS NOT NULL)",
    ]
    ctes += domain_parts_ctes("b", "qname")
    ctes += [
        f"enr0 AS (SELECT tenant{more}, event_date, event_ts, id, qr, rcode, qtype, src_ip, qname, name, "
        f"CAST(length(qname) AS INTEGER) AS qname_length, subdomain, domain, suffix, root_domain, subdomain_label_count, "
        f"{clean_sql('qname')} AS cq, {clean_sql('subdomain')} AS cs FROM dp)",
        f"enr1 AS (SELECT * EXCLUDE (cq, cs), {entropy_sql('cq')} AS qname_entropy, {entropy_sql('cs')} AS subdomain_entropy, "
        "(subdomain IS NULL OR subdomain = '') AS is_apex, "
        "CAST(coalesce(regexp_matches(lower(qname), '[^a-z0-9.-]'), false) AS INTEGER) AS has_invalid_chars FROM enr0)",
        f"enr AS (SELECT *, qname_entropy / {HOST_ENTROPY_MAX!r} AS qname_entropy_norm, "
        f"subdomain_entropy / {HOST_ENTROPY_MAX!r} AS subdomain_entropy_norm, "
        f"qname_entropy >= {HIGH_ENTROPY_THRESHOLD} AS is_high_entropy, "
        f"{bin_sql('qname_entropy')} AS qname_entropy_bin, {bin_sql('subdomain_entropy')} AS subdomain_entropy_bin "
        "FROM enr1)",
    ]
    return ctes


def with_ctes(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def intent_sql(col: str, warn: float, alert: float) -> str:
    return f"CASE WHEN {col} >= {alert} THEN 'alert' WHEN {col} >= {warn} THEN 'warn' ELSE 'neutral' END"


def r6(x: str) -> str:
    return f"round({x}, 6)"


RISK_KPIS_BODY = """
, agg AS (
  SELECT tenant, event_date,
    CAST(coalesce(sum(CASE WHEN is_high_entropy THEN 1 ELSE 0 END), 0) AS BIGINT) AS high_entropy_query_count,
    CAST(sum(CASE WHEN is_apex THEN 1 ELSE 0 END) AS BIGINT) AS apex_count,
    CAST(sum(CASE WHEN has_invalid_chars = 1 THEN 1 ELSE 0 END) AS BIGINT) AS invalid_char_count,
    CAST(sum(CASE WHEN rcode = 3 THEN 1 ELSE 0 END) AS BIGINT) AS nxdomain_count,
    count(DISTINCT name) AS unique_queries,
    avg(qname_length) AS avg_query_length,
    CAST(max(qname_length) AS INTEGER) AS max_query_length,
    CAST(sum(CASE WHEN qname_length > 80 THEN 1 ELSE 0 END) AS BIGINT) AS long_query_count,
    max(qname_entropy) AS max_qname_entropy,
    count(*) AS total_count
  FROM enr GROUP BY tenant, event_date),
r AS (
  SELECT *, high_entropy_query_count / total_count AS high_entropy_query_ratio,
    apex_count / total_count AS apex_ratio, invalid_char_count / total_count AS invalid_char_ratio,
    nxdomain_count / total_count AS nxdomain_ratio, unique_queries / total_count AS unique_query_ratio,
    long_query_count / total_count AS long_query_ratio
  FROM agg)
"""


def _risk_select() -> str:
    intents = ", ".join(f"{intent_sql(m, w, a)} AS {m}_intent" for m, (w, a) in INTENT_THRESHOLDS.items())
    return (
        "SELECT tenant, event_date, high_entropy_query_count, "
        f"{r6('high_entropy_query_ratio')} AS high_entropy_query_ratio, apex_count, invalid_char_count, nxdomain_count, "
        f"{r6('avg_query_length')} AS avg_query_length, max_query_length, long_query_count, "
        f"{r6('max_qname_entropy')} AS max_qname_entropy, total_count, {r6('apex_ratio')} AS apex_ratio, "
        f"{r6('invalid_char_ratio')} AS invalid_char_ratio, {r6('nxdomain_ratio')} AS nxdomain_ratio, "
        f"{r6('unique_query_ratio')} AS unique_query_ratio, {r6('long_query_ratio')} AS long_query_ratio, "
        f"{intents} FROM r"
    )


def risk_kpis_sql() -> str:
    return "WITH " + ",\n".join(enriched_ctes()) + RISK_KPIS_BODY + _risk_select()


def gold_record_written_sql(tenant: str, day: str) -> str:
    record = f"SELECT * FROM ({_risk_select()}) WHERE tenant = '{tenant}' AND event_date = DATE '{day}'"
    return "WITH " + ",\n".join(gold_enr_ctes()) + RISK_KPIS_BODY + record


def enr_query(body: str, extra: list[str] | None = None, base: list[str] | None = None) -> str:
    return "WITH " + ",\n".join((base or enriched_ctes()) + (extra or [])) + "\n" + body


def answered_ctes() -> list[str]:
    """``answered``: silver rows with ``has_answer``, 1 on questions with a reply in time."""
    return silver_ctes() + [
        "rep AS (SELECT * FROM silver WHERE qr = 1 AND rrname IS NOT NULL)",
        "answered AS (SELECT s.*, CAST(CASE WHEN s.qr = 0 AND EXISTS (SELECT 1 FROM rep r WHERE r.tenant = s.tenant AND r.id = s.id "
        "AND r.qname = s.qname AND r.src_ip = s.dst_ip AND r.dst_ip = s.src_ip AND r.event_ts >= s.event_ts "
        "AND r.event_ts <= s.event_ts + INTERVAL 5 SECOND) THEN 1 ELSE 0 END AS INTEGER) AS has_answer FROM silver s)",
    ]


def gold_enr_ctes() -> list[str]:
    """``enr`` of the answered silver."""
    return enriched_ctes(answered_ctes(), ", has_answer", "answered")


def dns_query(body: str, extra: list[str] | None = None) -> str:
    return "WITH " + ",\n".join([f"dns AS ({STANDIN_SQL})"] + (extra or [])) + "\n" + body


def _base_kpis() -> tuple[list[str], str]:
    extra = [
        "src AS (SELECT tenant, event_date, count(DISTINCT src_ip) AS unique_src_ips FROM enr GROUP BY tenant, event_date)",
        "mx AS (SELECT tenant, event_date, qname AS max_entropy_qname FROM (SELECT tenant, event_date, qname, "
        "row_number() OVER (PARTITION BY tenant, event_date ORDER BY qname_entropy DESC NULLS LAST, qname ASC) AS rn "
        "FROM enr) WHERE rn = 1)",
        "agg AS (SELECT tenant, event_date, count(*) AS total_queries, count(DISTINCT name) AS unique_queries, "
        "count(DISTINCT root_domain) AS unique_root_domains, count(DISTINCT subdomain) AS unique_subdomains, "
        "avg(qname_entropy) AS avg_qname_entropy, max(qname_entropy) AS max_qname_entropy, "
        "avg(subdomain_entropy) AS avg_subdomain_entropy, max(subdomain_entropy) AS max_subdomain_entropy, "
        "avg(subdomain_label_count) AS avg_subdomain_count, CAST(max(subdomain_label_count) AS INTEGER) AS max_subdomain_count "
        "FROM enr GROUP BY tenant, event_date)",
    ]
    body = (
        "SELECT a.tenant, a.event_date, total_queries, unique_queries, unique_root_domains, unique_subdomains, "
        "s.unique_src_ips, round(avg_qname_entropy, 6) AS avg_qname_entropy, round(max_qname_entropy, 6) AS max_qname_entropy, "
        "round(avg_subdomain_entropy, 6) AS avg_subdomain_entropy, round(max_subdomain_entropy, 6) AS max_subdomain_entropy, "
        "round(avg_subdomain_count, 6) AS avg_subdomain_count, max_subdomain_count, m.max_entropy_qname "
        "FROM agg a JOIN src s ON s.tenant = a.tenant AND s.event_date IS NOT DISTINCT FROM a.event_date "
        "JOIN mx m ON m.tenant = a.tenant AND m.event_date IS NOT DISTINCT FROM a.event_date"
    )
    return extra, body


def base_kpis_sql() -> str:
    extra, body = _base_kpis()
    return enr_query(body, extra)


def name_features_sql() -> str:
    return enr_query(
        "SELECT DISTINCT qname, qname_length, round(qname_entropy, 6) AS qname_entropy, "
        "round(qname_entropy_norm, 6) AS qname_entropy_norm, round(subdomain_entropy, 6) AS subdomain_entropy, "
        "round(subdomain_entropy_norm, 6) AS subdomain_entropy_norm, is_apex, has_invalid_chars, is_high_entropy, "
        "qname_entropy_bin, subdomain_entropy_bin FROM enr"
    )


def domain_parts_sql() -> str:
    ctes = [f"dns AS ({STANDIN_SQL})", "names AS (SELECT DISTINCT qname FROM dns WHERE qname IS NOT NULL)"]
    ctes += domain_parts_ctes("names", "qname")
    return "WITH " + ",\n".join(ctes) + "\nSELECT qname, subdomain, domain, suffix, root_domain, subdomain_label_count FROM dp"


def bins_values() -> str:
    return ", ".join(f"({i}, '{label}', CAST({float(lo)} AS DOUBLE))" for i, (label, lo, _) in enumerate(ENTROPY_BINS))


def hist_flat_ctes() -> list[str]:
    return [
        "hk AS (SELECT DISTINCT tenant, event_date FROM enr)",
        f"hb(bin_ord, bin, lower) AS (VALUES {bins_values()})",
        "ht(entropy_type) AS (VALUES ('qname'), ('subdomain'))",
        "hc AS (SELECT tenant, event_date, 'qname' AS entropy_type, qname_entropy_bin AS bin, count(*) AS c FROM enr "
        "WHERE qname_entropy_bin IS NOT NULL GROUP BY ALL UNION ALL "
        "SELECT tenant, event_date, 'subdomain', subdomain_entropy_bin, count(*) FROM enr "
        "WHERE NOT is_apex AND subdomain_entropy_bin IS NOT NULL GROUP BY ALL)",
        "hflat AS (SELECT k.tenant, k.event_date, t.entropy_type, CAST(b.bin_ord AS INTEGER) AS bin_ord, b.bin, "
        "b.lower, CAST(coalesce(c.c, 0) AS BIGINT) AS count FROM hk k CROSS JOIN hb b CROSS JOIN ht t "
        "LEFT JOIN hc c ON c.tenant = k.tenant AND c.event_date IS NOT DISTINCT FROM k.event_date AND c.entropy_type = t.entropy_type "
        "AND c.bin = b.bin)",
    ]


def hist_flat_sql() -> str:
    return enr_query("SELECT * FROM hflat", hist_flat_ctes())


def topn_ctes() -> list[str]:
    def plain(col: str, label: str, nulls: str) -> str:
        return (
            f"SELECT tenant, event_date, '{label}' AS topN_type, CAST(rn AS INTEGER) AS rank, name, query_count, "
            "CAST(NULL AS DOUBLE) AS entropy FROM (SELECT *, row_number() OVER (PARTITION BY tenant, event_date "
            f"ORDER BY query_count DESC, name ASC {nulls}) AS rn FROM (SELECT tenant, event_date, {col} AS name, "
            f"count(*) AS query_count FROM enr GROUP BY ALL)) WHERE rn <= 10"
        )

    high = (
        "SELECT tenant, event_date, 'high_entropy' AS topN_type, CAST(rn AS INTEGER) AS rank, name, query_count, "
        "round(entropy, 6) AS entropy FROM (SELECT *, row_number() OVER (PARTITION BY tenant, event_date "
        "ORDER BY round(entropy, 9) DESC NULLS LAST, name ASC) AS rn FROM (SELECT tenant, event_date, qname AS name, "
        "count(*) AS query_count, max(qname_entropy) AS entropy FROM enr WHERE is_high_entropy GROUP BY ALL)) WHERE rn <= 10"
    )
    return [
        f"t_q AS ({plain('qname', 'top_qnames', 'NULLS FIRST')})",
        f"t_r AS ({plain('root_domain', 'top_root_domains', 'NULLS FIRST')})",
        f"t_h AS ({high})",
        "tflat AS (SELECT * FROM t_q UNION ALL SELECT * FROM t_r UNION ALL SELECT * FROM t_h)",
    ]


def topn_sql(table: str) -> str:
    return enr_query(f"SELECT * FROM {table}", topn_ctes())


def topn_clients_sql() -> str:
    """The most frequent source addresses of each tenant-day."""
    counts = "per_client AS (SELECT tenant, event_date, src_ip AS name, count(*) AS query_count FROM dns GROUP BY ALL)"
    order = "PARTITION BY tenant, event_date ORDER BY query_count DESC, name NULLS FIRST"
    placed = f"placed AS (SELECT *, row_number() OVER ({order}) AS place FROM per_client)"
    columns = "tenant, event_date, 'top_clients' AS topN_type, CAST(place AS INTEGER) AS rank, name, query_count"
    return dns_query(f"SELECT {columns}, CAST(NULL AS DOUBLE) AS entropy FROM placed WHERE place <= {TOP_N}", [counts, placed])


BREAKDOWNS_CTE = (
    "bflat AS (SELECT tenant, event_date, 'qtype_breakdown' AS breakdown_type, qtype AS code, count(*) AS count "
    "FROM dns WHERE qr = 0 GROUP BY ALL UNION ALL SELECT tenant, event_date, 'rcode_breakdown', rcode, count(*) "
    "FROM dns WHERE qr = 1 GROUP BY ALL)"
)


def breakdowns_sql() -> str:
    return dns_query("SELECT * FROM bflat", [BREAKDOWNS_CTE])


def dashboard_parts_sql() -> str:
    """Every number of the five gold tables as (part, position, item, value)."""
    extra, base = _base_kpis()
    risk_ctes = RISK_KPIS_BODY.strip().lstrip(",").replace("agg AS", "risk_agg AS", 1).replace("FROM agg)", "FROM risk_agg)")
    breakdowns = BREAKDOWNS_CTE.replace("FROM dns", "FROM answered")
    columns = "(* EXCLUDE (tenant, event_date, {}))"

    def numbers(part: str, text: list[str]) -> str:
        cells = f"SELECT tenant, event_date, CAST(COLUMNS{columns.format(', '.join(text))} AS DOUBLE) FROM {part}"
        return (
            f"SELECT tenant, event_date, '{part}' AS part, 0 AS position, item, value FROM "
            f"(UNPIVOT ({cells}) ON COLUMNS(* EXCLUDE (tenant, event_date)) INTO NAME item VALUE value)"
        )

    def words(part: str, text: list[str]) -> list[str]:
        return [f"SELECT tenant, event_date, '{part}', 0, '{c}=' || {c}, 0.0::DOUBLE FROM {part} WHERE {c} IS NOT NULL" for c in text]

    intents = [f"{m}_intent" for m in INTENT_THRESHOLDS]
    parts = [
        "SELECT tenant, event_date, entropy_type AS part, bin_ord AS position, bin AS item, CAST(count AS DOUBLE) AS value FROM hflat",
        "SELECT tenant, event_date, topN_type, rank, name, CAST(query_count AS DOUBLE) FROM tflat",
        "SELECT tenant, event_date, breakdown_type, 0, CAST(code AS VARCHAR), CAST(count AS DOUBLE) FROM bflat",
        numbers("base_kpis", ["max_entropy_qname"]),
        *words("base_kpis", ["max_entropy_qname"]),
        numbers("risk_kpis", intents),
        *words("risk_kpis", intents),
    ]
    more = [*extra, f"base_kpis AS ({base})", risk_ctes, f"risk_kpis AS ({_risk_select()})", *topn_ctes(), *hist_flat_ctes(), breakdowns]
    return enr_query("\nUNION ALL ".join(parts), more, gold_enr_ctes())


def bins_measured_sql() -> str:
    return enr_query(
        f"SELECT b.ord, b.bin, b.lower, count(DISTINCT e.qname) AS names FROM (VALUES {bins_values()}) b(ord, bin, lower) "
        "LEFT JOIN enr e ON e.qname_entropy_bin = b.bin GROUP BY ALL"
    )


def template_sql(name: str, tenant: str, limit: int) -> str:
    where = f"tenant = '{tenant}'"
    if name == "avg_entropy":
        e = entropy_sql(clean_sql("qname"))
        return dns_query(
            f"SELECT qname, round({e}, 6) AS avg_entropy, query_count FROM (SELECT qname, count(*) AS query_count "
            f"FROM dns WHERE {where} AND qname IS NOT NULL GROUP BY qname) ORDER BY {e} DESC NULLS LAST, qname LIMIT {limit}"
        )
    if name == "nx_domain":
        return dns_query(
            f"SELECT qname, count(*) AS nxdomain_count FROM dns WHERE {where} AND rcode = 3 GROUP BY qname "
            f"ORDER BY nxdomain_count DESC, qname NULLS FIRST LIMIT {limit}"
        )
    if name == "qname_length":
        return dns_query(
            f"SELECT qname, CAST(length(qname) AS INTEGER) AS qname_length FROM (SELECT DISTINCT qname FROM dns "
            f"WHERE {where} AND qname IS NOT NULL) ORDER BY qname_length DESC, qname LIMIT {limit}"
        )
    key, alias = {"top_domains": ("qname", "qname"), "top_query_types": ("qtype", "qtype"), "topn_clients": ("src_ip", "client_ip")}[name]
    return dns_query(
        f"SELECT {key} AS {alias}, count(*) AS query_count FROM dns WHERE {where} GROUP BY {key} "
        f"ORDER BY query_count DESC, {alias} NULLS LAST LIMIT {limit}"
    )


def _gold_wide_scalars() -> tuple[list[str], str]:
    extra = [
        "src AS (SELECT tenant, event_date, count(DISTINCT src_ip) AS unique_src_ips FROM enr GROUP BY tenant, event_date)",
        "mx AS (SELECT tenant, event_date, qname AS max_entropy_qname FROM (SELECT tenant, event_date, qname, "
        "row_number() OVER (PARTITION BY tenant, event_date ORDER BY qname_entropy DESC NULLS LAST, qname ASC) AS rn "
        "FROM enr) WHERE rn = 1)",
        "agg AS (SELECT tenant, event_date, count(*) AS total_queries, count(DISTINCT qname) AS unique_qnames, "
        "count(DISTINCT root_domain) AS unique_root_domains, count(DISTINCT subdomain) AS unique_subdomains, "
        "avg(qname_entropy) AS avg_qname_entropy, max(qname_entropy) AS max_qname_entropy, "
        "avg(subdomain_entropy) AS avg_subdomain_entropy, max(subdomain_entropy) AS max_subdomain_entropy, "
        "avg(subdomain_label_count) AS avg_subdomain_count, CAST(max(subdomain_label_count) AS INTEGER) AS max_subdomain_count, "
        "CAST(sum(has_answer) AS BIGINT) AS answered_queries, "
        "CAST(coalesce(sum(CASE WHEN is_high_entropy THEN 1 ELSE 0 END), 0) AS BIGINT) AS high_entropy_query_count, "
        "CAST(sum(CASE WHEN rcode = 3 THEN 1 ELSE 0 END) AS BIGINT) AS nxdomain_count FROM enr GROUP BY tenant, event_date)",
    ]
    body = (
        "SELECT a.tenant, a.event_date, total_queries, unique_qnames, unique_root_domains, unique_subdomains, s.unique_src_ips, "
        "round(avg_qname_entropy, 6) AS avg_qname_entropy, round(max_qname_entropy, 6) AS max_qname_entropy, "
        "round(avg_subdomain_entropy, 6) AS avg_subdomain_entropy, round(max_subdomain_entropy, 6) AS max_subdomain_entropy, "
        "round(avg_subdomain_count, 6) AS avg_subdomain_count, max_subdomain_count, answered_queries, high_entropy_query_count, "
        "round(high_entropy_query_count / total_queries, 6) AS high_entropy_query_ratio, m.max_entropy_qname, nxdomain_count, "
        "round(nxdomain_count / total_queries, 6) AS nxdomain_ratio, "
        "high_entropy_query_count / total_queries >= 0.1 AS alert_high_entropy, nxdomain_count / total_queries >= 0.15 AS alert_nxdomain "
        "FROM agg a JOIN src s ON s.tenant = a.tenant AND s.event_date IS NOT DISTINCT FROM a.event_date "
        "JOIN mx m ON m.tenant = a.tenant AND m.event_date IS NOT DISTINCT FROM a.event_date"
    )
    return extra, body


def gold_wide_scalars_sql() -> str:
    extra, body = _gold_wide_scalars()
    return enr_query(body, extra, gold_enr_ctes())


def gold_wide_sql() -> str:
    """The scalars, and the lists of the wide record as text."""
    extra, body = _gold_wide_scalars()
    extra = extra + topn_ctes() + hist_flat_ctes() + [
        f"scalars AS ({body})",
        "tq AS (SELECT tenant, event_date, string_agg(name || '=' || query_count, ',' ORDER BY rank) AS top_qnames FROM t_q GROUP BY ALL)",
        "hh AS (SELECT tenant, event_date, string_agg(bin || '=' || count, ',' ORDER BY bin_ord) FILTER (entropy_type = 'qname') AS qname_histogram, "
        "string_agg(bin || '=' || count, ',' ORDER BY bin_ord) FILTER (entropy_type = 'subdomain') AS subdomain_histogram FROM hflat GROUP BY ALL)",
    ]
    return enr_query(
        "SELECT s.*, tq.top_qnames, hh.qname_histogram, hh.subdomain_histogram FROM scalars s "
        "LEFT JOIN tq ON tq.tenant = s.tenant AND tq.event_date IS NOT DISTINCT FROM s.event_date "
        "LEFT JOIN hh ON hh.tenant = s.tenant AND hh.event_date IS NOT DISTINCT FROM s.event_date",
        extra,
        gold_enr_ctes(),
    )


def has_answer_within_sql() -> str:
    return "WITH " + ",\n".join(answered_ctes()) + (
        "\nSELECT tenant, event_date, id, qname, has_answer FROM answered WHERE qr = 0 AND qname IS NOT NULL"
    )


def hist_wide_flat_sql() -> str:
    return enr_query(
        "SELECT tenant, event_date, bin_ord, bin, max(CASE WHEN entropy_type = 'qname' THEN count END) AS qname_count, "
        "max(CASE WHEN entropy_type = 'subdomain' THEN count END) AS subdomain_count FROM hflat GROUP BY ALL",
        hist_flat_ctes(),
    )


def gold_record_sql(tenant: str, day: str) -> str:
    return f"SELECT * FROM ({risk_kpis_sql()}) t WHERE tenant = '{tenant}' AND event_date = DATE '{day}'"


def hist_share_sql() -> str:
    return enr_query(
        "SELECT tenant, event_date, entropy_type, bin_ord, bin, count, "
        "round(CASE WHEN sum(count) OVER w > 0 THEN CAST(count AS DOUBLE) * 100 / sum(count) OVER w ELSE 0.0 END, 6) AS share_pct, "
        "min(CASE WHEN lower >= 3.0 THEN bin_ord END) OVER w AS first_high_bin FROM hflat "
        "WINDOW w AS (PARTITION BY tenant, event_date, entropy_type)",
        hist_flat_ctes(),
    )


def high_entropy_pct_sql() -> str:
    return enr_query(
        "SELECT tenant, event_date, entropy_type, round(CASE WHEN sum(count) > 0 THEN "
        "CAST(sum(CASE WHEN lower >= 3.0 THEN count ELSE 0 END) AS DOUBLE) * 100 / sum(count) ELSE 0.0 END, 6) "
        "AS high_entropy_pct FROM hflat GROUP BY ALL",
        hist_flat_ctes(),
    )


def breakdown_view_sql() -> str:
    return dns_query(
        "SELECT tenant, event_date, breakdown_type, coalesce(code, -1) AS code, count, "
        "CAST(row_number() OVER (PARTITION BY tenant, event_date, breakdown_type ORDER BY count DESC, code ASC) AS INTEGER) "
        "AS position FROM bflat",
        [BREAKDOWNS_CTE],
    )


def ranking_view_sql() -> str:
    return enr_query(
        "SELECT tenant, event_date, topN_type, rank, coalesce(name, 'Unknown') AS name, query_count, "
        "round((query_count - min(query_count) OVER w) / CASE WHEN max(query_count) OVER w - min(query_count) OVER w = 0 "
        "THEN 1 ELSE max(query_count) OVER w - min(query_count) OVER w END, 6) AS intensity FROM tflat "
        "WINDOW w AS (PARTITION BY tenant, event_date, topN_type)",
        topn_ctes(),
    )


def ranking_by_count_sql() -> str:
    return enr_query(
        "SELECT *, CAST(row_number() OVER (PARTITION BY tenant, event_date, topN_type ORDER BY query_count DESC, rank ASC) "
        "AS INTEGER) AS position FROM t_h",
        topn_ctes(),
    )


def names_by_length_sql(tenant: str, limit: int) -> str:
    inner = template_sql("qname_length", tenant, limit)
    return (
        "SELECT qname, qname_length, CAST(row_number() OVER (ORDER BY qname_length ASC, qname ASC) AS INTEGER) AS position "
        f"FROM ({inner}) t"
    )


def equal_width_sql(values_cte: str, k: int) -> str:
    """Equal-width histogram per tenant over relation ``v(tenant, x)``."""
    ctes = [
        f"dns AS ({STANDIN_SQL})",
        values_cte,
        "v2 AS (SELECT tenant, CAST(x AS DOUBLE) AS x FROM v WHERE x IS NOT NULL)",
        "st AS (SELECT tenant, min(x) AS lo, max(x) AS hi FROM v2 GROUP BY tenant)",
        f"bx AS (SELECT v2.tenant, CASE WHEN hi = lo THEN 0 ELSE least(CAST(floor((x - lo) / ((hi - lo) / {k})) AS INTEGER), {k - 1}) "
        "END AS idx FROM v2 JOIN st ON st.tenant = v2.tenant)",
        f"bins AS (SELECT CAST(unnest(range(0, {k})) AS INTEGER) AS bin_index)",
        f"g AS (SELECT st.tenant, lo, hi, (hi - lo) / {k} AS w, bin_index, "
        "(SELECT count(*) FROM bx WHERE bx.tenant = st.tenant AND bx.idx = bins.bin_index) AS count FROM st CROSS JOIN bins)",
    ]
    body = (
        "SELECT tenant, bin_index, round(lo + bin_index * w, 6) AS lower, round((lo + bin_index * w) + w, 6) AS upper, "
        "round(((lo + bin_index * w) + ((lo + bin_index * w) + w)) / 2, 6) AS midpoint, count FROM g"
    )
    return "WITH " + ",\n".join(ctes) + "\n" + body


def avg_entropy_histogram_sql() -> str:
    e = entropy_sql(clean_sql("qname"))
    return equal_width_sql(
        f"v AS (SELECT tenant, {e} AS x FROM (SELECT DISTINCT tenant, qname FROM dns WHERE qname IS NOT NULL))", 10
    )


def name_length_histogram_sql() -> str:
    return equal_width_sql(
        "v AS (SELECT tenant, length(qname) AS x FROM (SELECT DISTINCT tenant, qname FROM dns WHERE qname IS NOT NULL))", 20
    )


def root_cardinality_sql() -> str:
    return enr_query(
        "SELECT e.tenant, e.event_date, e.id, e.qname, e.root_domain, c.root_domain_cardinality FROM enr e "
        "LEFT JOIN (SELECT root_domain, count(DISTINCT subdomain) AS root_domain_cardinality FROM enr GROUP BY root_domain) c "
        "ON c.root_domain = e.root_domain"
    )


def time_features_sql() -> str:
    return dns_query(
        "SELECT d.tenant, d.id, d.qname, CAST(hour(d.event_ts) AS INTEGER) AS hour_of_day, "
        "CAST(dayofweek(d.event_ts) + 1 AS INTEGER) AS day_of_week, pn.query_frequency, pn.unique_src_ips "
        "FROM dns d JOIN (SELECT qname, count(DISTINCT id) AS query_frequency, count(DISTINCT src_ip) AS unique_src_ips "
        "FROM dns WHERE qname IS NOT NULL GROUP BY qname) pn ON pn.qname = d.qname"
    )


_SUB_NORM = "array_to_string(list_filter(string_split_regex(lower(subdomain), '\\.+'), lambda x: x <> ''), '.')"


def window_cardinality_sql() -> str:
    return enr_query(
        "SELECT tenant, root_domain, window_start, window_start + INTERVAL 1 day AS window_end, "
        "count(DISTINCT sub_norm) AS root_subdomain_cardinality_window FROM (SELECT tenant, root_domain, "
        f"time_bucket(INTERVAL 1 day, event_ts) AS window_start, {_SUB_NORM} AS sub_norm FROM enr) "
        "WHERE root_domain IS NOT NULL AND sub_norm IS NOT NULL AND length(sub_norm) >= 1 GROUP BY ALL"
    )


def window_cardinality_approx_sql() -> str:
    return (
        "SELECT tenant, root_domain, window_start, root_subdomain_cardinality_window, true AS within_bound "
        f"FROM ({window_cardinality_sql()}) t"
    )


def window_cardinality_sliding_sql() -> str:
    return enr_query(
        "SELECT root_domain, window_start, window_start + INTERVAL 2 day AS window_end, "
        "count(DISTINCT sub_norm) AS root_subdomain_cardinality_window FROM ("
        f"SELECT root_domain, time_bucket(INTERVAL 1 day, event_ts) AS window_start, {_SUB_NORM} AS sub_norm FROM enr "
        "UNION ALL "
        f"SELECT root_domain, time_bucket(INTERVAL 1 day, event_ts) - INTERVAL 1 day, {_SUB_NORM} FROM enr) "
        "WHERE root_domain IS NOT NULL AND sub_norm IS NOT NULL AND length(sub_norm) >= 1 GROUP BY ALL"
    )


def window_cardinality_stored_sql() -> str:
    return (
        "SELECT root_domain, window_start, root_subdomain_cardinality_window, true AS within_bound "
        f"FROM ({window_cardinality_sliding_sql()}) t"
    )


def weekly_uniques_sql() -> str:
    return enr_query(
        "SELECT tenant, CAST(date_trunc('week', event_date) AS DATE) AS week, count(DISTINCT name) AS unique_name, "
        "count(DISTINCT root_domain) AS unique_root_domain, count(DISTINCT subdomain) AS unique_subdomain, "
        "true AS within_bound FROM enr GROUP BY ALL"
    )


def subdomain_map_sql() -> str:
    return enr_query(
        "SELECT p.root_domain, p.subdomain, s.subdomain_count FROM (SELECT DISTINCT root_domain, subdomain FROM enr "
        "WHERE root_domain IS NOT NULL AND subdomain IS NOT NULL AND subdomain <> '') p JOIN "
        "(SELECT root_domain, count(*) AS subdomain_count FROM (SELECT DISTINCT root_domain, subdomain FROM enr "
        "WHERE root_domain IS NOT NULL AND subdomain IS NOT NULL AND subdomain <> '') GROUP BY root_domain) s "
        "ON s.root_domain = p.root_domain"
    )


def entropy_variants_sql() -> str:
    raw = entropy_sql("nullif(qname, '')")
    stripped = entropy_sql("nullif(regexp_replace(qname, '^\\s+|\\s+$', '', 'g'), '')")
    return dns_query(
        f"SELECT qname, round(coalesce({raw}, 0.0), 6) AS entropy_raw, "
        f"CASE WHEN qname IS NOT NULL THEN round(coalesce({stripped}, 0.0), 6) END AS entropy_stripped, "
        f"round({entropy_sql(clean_sql('qname'))}, 6) AS entropy_bits, {clean_sql('qname')} AS clean_host "
        "FROM (SELECT DISTINCT qname FROM dns WHERE qname IS NOT NULL)"
    )


def label_features_sql() -> str:
    ctes = [f"dns AS ({STANDIN_SQL})", "names AS (SELECT DISTINCT qname FROM dns WHERE qname IS NOT NULL)"]
    ctes += domain_parts_ctes("names", "qname")
    ctes += [
        "lf AS (SELECT *, list_transform(list_filter(string_split(qname, '.'), lambda x: x <> ''), lambda x: length(x)) AS ll, "
        "length(coalesce(domain, '')) AS dl, length(coalesce(suffix, '')) AS sl, "
        "CASE WHEN subdomain IS NULL OR lower(subdomain) = 'null' THEN NULL ELSE trim(subdomain) END AS sb FROM dp)"
    ]
    body = (
        "SELECT qname, array_to_string(ll, ',') AS label_lengths, "
        "CAST(CASE WHEN len(ll) > 0 THEN list_max(ll) END AS INTEGER) AS qname_label_len_max, "
        "CAST(CASE WHEN len(ll) > 0 THEN list_min(ll) END AS INTEGER) AS qname_label_len_min, "
        "round(CASE WHEN len(ll) > 0 THEN list_sum(ll) / len(ll) END, 6) AS qname_label_len_mean, "
        "round(CASE WHEN (CASE WHEN dl > 0 THEN 1 ELSE 0 END + CASE WHEN sl > 0 THEN 1 ELSE 0 END) > 0 THEN "
        "(dl + sl) / (CASE WHEN dl > 0 THEN 1 ELSE 0 END + CASE WHEN sl > 0 THEN 1 ELSE 0 END) END, 6) AS domain_suffix_len_mean, "
        "CAST(greatest(dl, sl) AS INTEGER) AS domain_suffix_len_max, "
        "CAST(least(CASE WHEN dl > 0 THEN dl END, CASE WHEN sl > 0 THEN sl END) AS INTEGER) AS domain_suffix_len_min, "
        "CAST(CASE WHEN sb IS NULL OR length(sb) = 0 THEN 0 ELSE "
        "len(list_filter(string_split_regex(lower(sb), '\\.+'), lambda x: x <> '')) END AS INTEGER) AS subdomain_label_count_clean, "
        "coalesce(contains(lower(qname), 'xn--'), false) AS is_idn FROM lf"
    )
    return "WITH " + ",\n".join(ctes) + "\n" + body


# ---------------------------------------------------------------------------
# Bronze -> silver twins (derived bronze built flat: messages, questions, answers)
# ---------------------------------------------------------------------------

STANDIN_WITH_ID_SQL = STANDIN_SQL.replace("end as qname\nfrom", "end as qname, e.event_id\nfrom")

SILVER_COLS = [
    "tenant", "event_date", "event_ts", "src_ip", "dst_ip", "dst_port", "id", "opcode", "qdcount", "qr", "rcode",
    "qname", "qtype", "qclass", "is_valid_question", "ancount", "rclass", "rdata", "rrname", "rtype", "ttl",
    "is_valid_answer",
]


def parse_ts_sql(t: str) -> str:
    d = f"try_cast({t} AS DOUBLE)"
    return (
        f"coalesce(try_strptime({t}, '%Y-%m-%dT%H:%M:%S.%f'), try_strptime({t}, '%Y-%m-%dT%H:%M:%S'), "
        f"CASE WHEN abs({d}) < 1e11 THEN make_timestamp(CAST(round({d} * 1000000) AS BIGINT)) "
        f"WHEN abs({d}) < 1e14 THEN make_timestamp(CAST(round({d} * 1000) AS BIGINT)) "
        f"WHEN abs({d}) < 1e17 THEN make_timestamp(CAST(round({d}) AS BIGINT)) END)"
    )


def bronze_ctes() -> list[str]:
    """``msg`` (one row per message, parsed time), ``qo``/``ao`` (questions / answers, outer), ``fm`` (B4 rows)."""
    epoch = (
        "CAST(epoch_us(event_ts) // 1000000 AS VARCHAR) || '.' || lpad(CAST(epoch_us(event_ts) % 1000000 AS VARCHAR), 6, '0')"
    )
    return [
        f"dns AS ({STANDIN_WITH_ID_SQL})",
        "m0 AS (SELECT *, 0 AS dup FROM dns UNION ALL "
        "SELECT * REPLACE (CASE WHEN event_id % 11 = 0 THEN upper(qname) || ' ' ELSE qname END AS qname), 1 AS dup FROM dns "
        "UNION ALL SELECT * REPLACE (event_ts + to_seconds(CASE WHEN event_id % 9 = 0 THEN 10 ELSE 1 END) AS event_ts), 2 AS dup "
        "FROM dns WHERE qr = 0 AND event_id % 3 = 0)",
        "m1 AS (SELECT tenant, event_id, dup, qname AS sq, qtype AS st, "
        "CASE WHEN dup = 2 THEN '10.0.1.' || CAST(event_id % 4 AS VARCHAR) ELSE src_ip END AS src_ip, "
        f"CASE WHEN event_id % 499 = 0 THEN 'junk' WHEN event_id % 5 = 0 THEN {epoch} "
        "ELSE strftime(event_ts, '%Y-%m-%dT%H:%M:%S.%f') END AS timestamp, "
        "CASE WHEN dup = 2 THEN src_ip ELSE '10.0.1.' || CAST(event_id % 4 AS VARCHAR) END AS dst_ip, CAST(1024 + event_id % 60000 AS INTEGER) AS src_port, "
        "53 AS dst_port, CAST((event_id - qr) % 65536 AS INTEGER) AS id, CASE WHEN dup = 2 THEN 1 ELSE qr END AS qr, 0 AS opcode, rcode, "
        "CAST(CASE WHEN dup = 2 THEN 1 WHEN qr = 0 AND event_id % 17 = 0 THEN 0 WHEN event_id % 23 = 0 THEN 2 ELSE 1 END AS INTEGER) AS qdcount, "
        "CAST(CASE WHEN dup = 2 THEN 1 WHEN qr = 1 THEN event_id % 3 ELSE 0 END AS INTEGER) AS ancount FROM m0)",
        f"msg AS (SELECT *, {parse_ts_sql('timestamp')} AS event_ts FROM m1)",
        "qq AS (SELECT event_id, dup, sq AS qname, st AS qtype, 1 AS qclass FROM msg WHERE qdcount >= 1 UNION ALL "
        "SELECT event_id, dup, 'www.' || sq, 1, 1 FROM msg WHERE qdcount = 2)",
        "qo AS (SELECT * FROM qq UNION ALL SELECT event_id, dup, NULL, NULL, NULL FROM msg WHERE qdcount = 0)",
        "aa AS (SELECT event_id, dup, sq AS rrname, CASE WHEN k = 1 THEN 1 ELSE 5 END AS rtype, 1 AS rclass, "
        "CAST(300 * k AS BIGINT) AS ttl, CASE WHEN k = 1 THEN '192.0.2.' || CAST(event_id % 256 AS VARCHAR) "
        "ELSE 'alias.' || sq END AS rdata FROM msg CROSS JOIN range(1, 3) r(k) WHERE k <= ancount)",
        "ao AS (SELECT * FROM aa UNION ALL SELECT event_id, dup, NULL, NULL, NULL, NULL, NULL FROM msg WHERE ancount = 0)",
        "fm AS (SELECT m.*, CAST(m.event_ts AS DATE) AS event_date, q.qname, q.qtype, q.qclass, a.rrname, a.rtype, "
        "a.rclass, a.rdata, a.ttl, CAST(q.qname IS NOT NULL AS INTEGER) AS is_valid_question, "
        "CAST(a.rrname IS NOT NULL AS INTEGER) AS is_valid_answer FROM msg m "
        "JOIN qo q ON q.event_id = m.event_id AND q.dup = m.dup JOIN ao a ON a.event_id = m.event_id AND a.dup = m.dup)",
    ]


def silver_ctes() -> list[str]:
    cols = ", ".join(SILVER_COLS)
    order = ", ".join(f"{c} NULLS FIRST" for c in SILVER_COLS + ["name"])

    def part(x: str) -> str:
        return f"coalesce(CAST({x} AS VARCHAR), '\\N')"

    key = ", ".join(
        part(x)
        for x in [
            "strftime(event_ts, '%Y-%m-%d %H:%M:%S.%f')", "id", "qr", "name", "coalesce(qtype, rtype)",
            "trim(lower(coalesce(rdata, '')))", "src_ip", "dst_ip",
        ]
    )
    return bronze_ctes() + [
        f"sv0 AS (SELECT {cols}, coalesce(trim(lower(qname)), trim(lower(rrname))) AS name FROM fm "
        "WHERE NOT (qr = 0 AND qdcount <= 0))",
        f"sv1 AS (SELECT *, sha256(concat_ws('||', {key})) AS silver_dedupe_hash FROM sv0)",
        f"silver AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY tenant, silver_dedupe_hash ORDER BY {order}) "
        "AS rn FROM sv1) WHERE rn = 1)",
    ]


def bronze_messages_sql() -> str:
    """Messages with their questions and answers as text."""
    return bronze_query(
        "SELECT m.tenant, m.timestamp, m.src_ip, m.dst_ip, m.src_port, CAST(m.dst_port AS INTEGER) AS dst_port, m.id, m.qr, "
        "CAST(m.opcode AS INTEGER) AS opcode, m.rcode, m.qdcount, m.ancount, "
        "coalesce(q.t, '') AS questions, coalesce(a.t, '') AS answers FROM msg m "
        "LEFT JOIN (SELECT event_id, dup, string_agg(coalesce(qname, '') || ':' || qtype || ':' || qclass, '|' ORDER BY second) AS t "
        "FROM (SELECT *, CAST(qname LIKE 'www.%' AS INTEGER) AS second FROM qq) GROUP BY ALL) q ON q.event_id = m.event_id AND q.dup = m.dup "
        "LEFT JOIN (SELECT event_id, dup, string_agg(coalesce(rrname, '') || ':' || rtype || ':' || rclass || ':' || ttl || ':' || coalesce(rdata, ''), '|' ORDER BY ttl) AS t "
        "FROM aa GROUP BY ALL) a ON a.event_id = m.event_id AND a.dup = m.dup"
    )


def bronze_query(body: str, silver: bool = False) -> str:
    return "WITH " + ",\n".join(silver_ctes() if silver else bronze_ctes()) + "\n" + body


def silver_sql() -> dict[str, str]:
    return {
        "event_time": bronze_query("SELECT tenant, id, qr, event_ts, CAST(event_ts AS DATE) AS event_date FROM msg"),
        "drop_empty_queries": bronze_query(
            "SELECT tenant, id, qr, qdcount, ancount FROM msg WHERE NOT (qr = 0 AND qdcount <= 0)"
        ),
        "flatten_questions": bronze_query(
            "SELECT m.tenant, m.event_ts, m.id, m.qr, m.rcode, m.src_ip, q.qname, q.qtype, q.qclass FROM msg m "
            "JOIN qo q ON q.event_id = m.event_id AND q.dup = m.dup"
        ),
        "flatten_answers": bronze_query(
            "SELECT m.tenant, m.event_ts, m.id, m.qr, a.rrname, a.rdata, a.rtype, a.rclass, a.ttl FROM msg m "
            "JOIN ao a ON a.event_id = m.event_id AND a.dup = m.dup"
        ),
        "flatten_messages": bronze_query(
            "SELECT tenant, event_ts, id, qr, qname, qtype, rrname, rtype, rdata, ttl, is_valid_question, is_valid_answer FROM fm"
        ),
        "explode_normalise": bronze_query(
            "SELECT m.tenant, m.id, m.qr, a.rrname, CAST(a.rtype AS VARCHAR) AS rtype, a.rdata, CAST(a.ttl AS VARCHAR) AS ttl "
            "FROM msg m JOIN aa a ON a.event_id = m.event_id AND a.dup = m.dup WHERE a.rrname IS NOT NULL"
        ),
        "standardize_schema": bronze_query(
            "SELECT tenant, try_strptime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, "
            "CAST(src_port AS VARCHAR) AS src_port, CAST(id AS BIGINT) AS id, CAST(qdcount AS DOUBLE) AS qdcount FROM msg"
        ),
        "split_questions": bronze_query("SELECT tenant, event_ts, id, qname, rrname FROM fm WHERE qr = 0"),
        "split_answers": bronze_query("SELECT tenant, event_ts, id, qname, rrname FROM fm WHERE qr = 1"),
        "dedupe_hash": bronze_query("SELECT silver_dedupe_hash, name, event_ts, id, qr FROM silver", silver=True),
        "silver": bronze_query(f"SELECT {', '.join(SILVER_COLS)}, name FROM silver", silver=True),
        "has_answer": bronze_query(
            "SELECT q.tenant, q.event_date, q.id, q.qname, CAST(coalesce(a.f, 0) AS INTEGER) AS has_answer "
            "FROM silver q LEFT JOIN (SELECT DISTINCT tenant, id, 1 AS f FROM silver WHERE qr = 1 AND rrname IS NOT NULL) a "
            "ON a.tenant = q.tenant AND a.id = q.id WHERE q.qr = 0 AND q.qname IS NOT NULL",
            silver=True,
        ),
        "silver_questions": bronze_query(
            f"SELECT {', '.join(SILVER_COLS)}, name FROM silver WHERE qname IS NOT NULL", silver=True
        ),
    }


# ---------------------------------------------------------------------------
# Decoded packets and object keys
# ---------------------------------------------------------------------------


def _services_values() -> str:
    from zonelens.sources.dims import SEED_SERVICES

    rows = [line.split() for line in SEED_SERVICES.strip().splitlines()]
    return ", ".join(f"('{proto}', {int(port)}, '{name}')" for port, proto, name in rows)


def packets_ctes() -> list[str]:
    path = "'/p/' || CAST(event_id % 1000 AS VARCHAR)"
    tcp_payload = (
        f"CASE WHEN event_id % 12 = 0 THEN 'GET ' || {path} || ' HTTP/1.1' "
        f"WHEN event_id % 4 = 0 AND event_id % 8 = 0 THEN 'POST ' || {path} || ' HTTP/1.1' "
        f"WHEN event_id % 4 = 0 THEN 'GET ' || {path} || ' HTTP/1.1' "
        "WHEN event_id % 4 = 1 AND event_id % 3 = 0 THEN 'HTTP/1.1 404 Not Found' "
        "WHEN event_id % 4 = 1 THEN 'HTTP/1.1 200 OK' "
        "ELSE chr(22) || chr(3) || chr(1) || ' tls ' || CAST(event_id AS VARCHAR) END"
    )
    names = " ".join(f"WHEN {n} THEN '{v}'" for n, v in __import__("zonelens.config", fromlist=["x"]).IP_PROTOCOL_NAMES.items())
    m = "CAST(round(epoch * 1000000) AS BIGINT)"
    return [
        "pk AS (SELECT *, CASE WHEN event_id % 41 = 0 THEN NULL WHEN event_type = 'click' THEN 17 "
        "WHEN event_type IN ('view', 'signup') THEN 6 WHEN event_type = 'purchase' THEN 1 "
        "WHEN event_id % 2 = 0 THEN 47 ELSE 89 END AS proto, CAST(1024 + event_id % 50000 AS INTEGER) AS eph FROM events)",
        "pk2 AS (SELECT epoch_us(ts) / 1000000 AS epoch, '10.0.0.' || CAST(user_id % 256 AS VARCHAR) AS src_ip, "
        "'10.0.1.' || CAST(event_id % 256 AS VARCHAR) AS dst_ip, proto, CAST(5 + event_id % 3 AS INTEGER) AS ihl, "
        "CAST(40 + CAST(floor(abs(value)) AS INTEGER) % 1400 AS INTEGER) AS packet_size, "
        "CAST(CASE WHEN proto = 17 THEN CASE WHEN event_id % 3 = 0 THEN eph WHEN event_id % 3 = 1 THEN 53 ELSE 5353 END "
        "WHEN proto = 6 THEN CASE WHEN event_id % 37 = 0 THEN 0 WHEN event_id % 4 = 1 THEN 80 ELSE eph END END AS INTEGER) AS src_port, "
        "CAST(CASE WHEN proto = 17 THEN CASE WHEN event_id % 3 = 0 THEN 53 WHEN event_id % 3 = 1 THEN eph ELSE 123 END "
        "WHEN proto = 6 THEN CASE WHEN event_id % 4 = 0 THEN 80 WHEN event_id % 4 = 1 THEN eph WHEN event_id % 4 = 2 THEN 53 "
        "WHEN event_id % 5 = 0 THEN 1024 ELSE 443 END END AS INTEGER) AS dst_port, "
        "CASE WHEN proto = 6 THEN CASE WHEN event_id % 2 = 0 THEN 'PA' ELSE 'S' END END AS tcp_flags, "
        f"CASE WHEN proto = 6 THEN {tcp_payload} WHEN proto = 17 THEN 'dns-' || CAST(event_id AS VARCHAR) ELSE '' END AS ptext "
        "FROM pk)",
        f"cl AS (SELECT *, CASE proto {names} ELSE CAST(proto AS VARCHAR) END AS ip_protocol, "
        f"CASE WHEN {m} % 1000000 = 0 THEN strftime(make_timestamp({m}), '%Y-%m-%dT%H:%M:%S') "
        f"ELSE strftime(make_timestamp({m}), '%Y-%m-%dT%H:%M:%S.%f') END AS timestamp FROM pk2 WHERE proto IS NOT NULL)",
        "c2 AS (SELECT *, coalesce(ip_protocol IN ('UDP', 'TCP') AND (src_port = 53 OR dst_port = 53), false) AS is_dns, "
        "(starts_with(ptext, 'GET') OR starts_with(ptext, 'POST')) AS is_req, starts_with(ptext, 'HTTP') AS is_resp FROM cl)",
        "c3 AS (SELECT *, ip_protocol = 'TCP' AND coalesce(is_req OR is_resp, false) AS is_http FROM c2)",
        f"svc(proto, port, service) AS (VALUES {_services_values()})",
        "classified AS (SELECT timestamp, src_ip, dst_ip, ip_protocol, ihl * 4 AS ip_header_length, packet_size, "
        "CASE WHEN ip_protocol IN ('TCP', 'UDP') THEN src_port END AS src_port, "
        "CASE WHEN ip_protocol IN ('TCP', 'UDP') THEN dst_port END AS dst_port, "
        "CASE WHEN ip_protocol = 'TCP' THEN tcp_flags END AS tcp_flags, "
        "CASE WHEN is_dns THEN 'dns' WHEN is_http THEN 'http' ELSE 'other' END AS packet_class, "
        "CASE WHEN NOT is_dns AND is_http THEN CASE WHEN is_req THEN 'request' ELSE 'response' END ELSE 'other' END AS type, "
        "CASE WHEN NOT is_dns AND is_http AND is_req THEN split_part(ptext, ' ', 1) END AS method, "
        "CASE WHEN NOT is_dns AND is_http AND is_req THEN split_part(ptext, ' ', 2) END AS path, "
        "CASE WHEN NOT is_dns AND is_http AND NOT is_req AND is_resp THEN split_part(ptext, ' ', 2) END AS status_code, "
        "s1.service AS src_service, s2.service AS dst_service FROM c3 "
        "LEFT JOIN svc s1 ON s1.proto = lower(ip_protocol) AND s1.port = src_port AND src_port > 0 AND src_port <= 1023 "
        "LEFT JOIN svc s2 ON s2.proto = lower(ip_protocol) AND s2.port = dst_port AND dst_port > 0 AND dst_port <= 1023)",
    ]


def packets_sql() -> dict[str, str]:
    def q(body: str) -> str:
        return "WITH " + ",\n".join(packets_ctes()) + "\n" + body

    return {
        "packets_classified": q("SELECT * FROM classified"),
        "packet_class_counts": q("SELECT packet_class, count(*) AS packets FROM classified GROUP BY packet_class"),
        "dns_packets": q(
            "SELECT timestamp, src_ip, dst_ip, src_port, dst_port FROM cl "
            "WHERE coalesce(ip_protocol = 'UDP' AND (src_port = 53 OR dst_port = 53), false)"
        ),
    }


def object_keys_sql() -> str:
    e = "CAST(event_id AS VARCHAR)"
    name = (
        f"CASE WHEN event_id % 6 = 0 THEN 'capture+' || {e} || '.pcap' WHEN event_id % 6 = 1 THEN 'cap%20' || {e} || '.PCAPNG' "
        f"WHEN event_id % 12 = 2 THEN '100%/file' || {e} WHEN event_id % 6 = 2 THEN 'file' || {e} WHEN event_id % 6 = 3 THEN 'f' || {e} || '.pcap.bak' "
        f"WHEN event_id % 6 = 4 THEN 'x_' || {e} || '.Pcap' ELSE 'a%2Fb' || {e} || '.pcapng' END"
    )
    tenant = "'tenant-' || CAST(user_id % 3 AS VARCHAR)"
    key = (
        f"CASE WHEN event_id % 53 = 0 THEN {tenant} || '/' ELSE (CASE WHEN event_id % 10 = 0 THEN '/' ELSE '' END) "
        f"|| {tenant} || '/pcaps/' || CAST(CAST(ts AS DATE) AS VARCHAR) || '/' || {name} END"
    )
    ctes = [
        f"k0 AS (SELECT {key} AS object_key FROM events)",
        # Escapes as they occur here; any other percent sign stays.
        "k1 AS (SELECT object_key, regexp_replace(replace(replace(replace(object_key, '+', ' '), '%20', ' '), '%2F', '/'), '^/+', '') AS norm FROM k0)",
        "k2 AS (SELECT *, list_filter(string_split(norm, '/'), lambda p: p <> '') AS parts FROM k1)",
        "k3 AS (SELECT *, CASE WHEN len(parts) > 0 THEN parts[1] END AS t, "
        "CASE WHEN len(parts) > 1 THEN array_to_string(parts[2:], '/') END AS r FROM k2)",
        "k4 AS (SELECT *, CASE WHEN t IS NULL THEN 'no tenant segment' WHEN r IS NULL THEN 'no file path after tenant' END AS reason FROM k3)",
    ]
    body = (
        "SELECT object_key, CASE WHEN reason IS NULL THEN t END AS tenant, CASE WHEN reason IS NULL THEN r END AS rest, "
        "CASE WHEN reason IS NULL THEN t || '/' || CASE WHEN regexp_matches(r, '\\.(pcap|pcapng)$', 'i') "
        "THEN regexp_replace(r, '\\.(pcap|pcapng)$', '.jsonl.gz', 'i') ELSE r || '.jsonl.gz' END END AS bronze_key, "
        "reason AS reject_reason FROM k4"
    )
    return "WITH " + ",\n".join(ctes) + "\n" + body


def render_rdata_sql() -> str:
    k = "event_id % 6"
    text = (
        f"CASE WHEN {k} = 0 THEN '192.0.2.' || CAST(event_id % 256 AS VARCHAR) "
        f"WHEN {k} = 1 THEN '2001:db8::' || lower(hex(event_id % 65536)) "
        f"WHEN {k} IN (2, 3) THEN 'alias.' || qname WHEN {k} = 4 THEN 'v=spf1 ' || 'include:' || qname "
        f"ELSE '10 mail.' || qname END"
    )
    return (
        f"WITH dns AS ({STANDIN_WITH_ID_SQL})\n"
        f"SELECT tenant, id, qname AS rrname, CAST(CASE WHEN {k} = 0 THEN 1 WHEN {k} = 1 THEN 28 WHEN {k} = 2 THEN 5 "
        f"WHEN {k} = 3 THEN 12 WHEN {k} = 4 THEN 16 ELSE 15 END AS INTEGER) AS rtype, {text} AS rdata FROM dns"
    )


def window_cardinality_rows_sql() -> str:
    return enr_query(
        "SELECT r.tenant, r.id, r.qname, r.root_domain, a.c AS root_subdomain_cardinality_window FROM "
        f"(SELECT *, time_bucket(INTERVAL 1 day, event_ts) AS ws, {_SUB_NORM} AS sub_norm FROM enr) r JOIN "
        f"(SELECT tenant, root_domain, ws, count(DISTINCT sub_norm) AS c FROM (SELECT tenant, root_domain, "
        f"time_bucket(INTERVAL 1 day, event_ts) AS ws, {_SUB_NORM} AS sub_norm FROM enr) "
        "WHERE root_domain IS NOT NULL AND sub_norm IS NOT NULL AND length(sub_norm) >= 1 GROUP BY ALL) a "
        "ON a.tenant = r.tenant AND a.root_domain = r.root_domain AND a.ws = r.ws "
        "WHERE r.root_domain IS NOT NULL AND r.sub_norm IS NOT NULL AND length(r.sub_norm) >= 1"
    )
