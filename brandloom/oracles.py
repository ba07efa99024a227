"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from .plans import rules


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def rnd(x: str, places: int = 6) -> str:
    return f"(floor(({x}) * 1e{places} + 0.5) / 1e{places})"


def clamp(x: str, low="0.0", high="1.0") -> str:
    return f"greatest({low}, least({high}, {x}))"


def phrase(x: str) -> str:
    return f"regexp_replace(lower(trim({x}, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))), '\\s+', ' ', 'g')"


def tokens(x: str) -> str:
    return f"list_filter(list_distinct(regexp_split_to_array(lower({x}), '[^a-z0-9]+')), lambda tok: tok <> '')"


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


def overlap(a: str, b: str) -> str:
    return f"CASE WHEN least(len({a}), len({b})) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / least(len({a}), len({b})) END"


def word(x: str, words: str) -> str:
    return f"regexp_matches({x}, {q(f'(^|[^A-Za-z0-9_])({words})([^A-Za-z0-9_]|$)')})"


def has(x: str, keyword: str) -> str:
    return f"contains({x}, {q(keyword)})" if " " in keyword else word(x, keyword)


def case(*parts: tuple[str, str], otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in parts) + f" ELSE {otherwise} END"


def picked(*parts: tuple[str, str]) -> str:
    """A list of the labels whose conditions hold."""
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {q(v)} END" for c, v in parts) + "], lambda lab: lab IS NOT NULL)"


def pipe(xs: str) -> str:
    return f"coalesce(array_to_string({xs}, '|'), '')"


# Stand-ins: the same as in the queries.
PLATFORM = "CASE event_type WHEN 'view' THEN 'youtube' WHEN 'click' THEN 'instagram' WHEN 'purchase' THEN 'tiktok' WHEN 'signup' THEN 'linkedin' ELSE 'unknown' END"
SIGNALS = f"signals AS (SELECT user_id AS creator, event_id, ts, {PLATFORM} AS platform, floor(value * 1000)::BIGINT AS followers, value FROM events)"
MEASURED = f"""{SIGNALS}, grouped AS (SELECT creator, platform, max(followers) AS f, count(*) AS n FROM signals GROUP BY ALL),
measured AS (SELECT creator, platform, f::DOUBLE AS followers, floor(f * 0.1 + n)::DOUBLE AS avg_views, n * 0.003::DOUBLE AS engagement_rate, least(0.95::DOUBLE, 0.2::DOUBLE + n * 0.05::DOUBLE) AS confidence, n::DOUBLE AS sample_size FROM grouped)"""
SOLD = "sold AS (SELECT o_custkey, c_nationkey, p_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey LEFT JOIN customer ON o_custkey = c_custkey)"
METRIC = "struct_pack(platform := platform, followers := followers, avg_views := avg_views, engagement_rate := engagement_rate, confidence := confidence, sample_size := sample_size)"
CREATORS = f"""{MEASURED}, {SOLD},
ctop AS (SELECT k, list(p_name ORDER BY r) AS topics FROM (SELECT o_custkey AS k, p_name, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, p_name) AS r FROM sold GROUP BY o_custkey, p_name) WHERE r <= 6 GROUP BY k),
cmet AS (SELECT creator, list({METRIC} ORDER BY platform) AS metrics FROM measured GROUP BY creator),
creators AS (
  SELECT c_custkey AS creator_id, lower(c_mktsegment) AS niche, coalesce(topics, []) AS topics, list_distinct([lower(n_name), lower(c_mktsegment)]) AS audience_types,
    list_transform(coalesce(metrics, []), lambda m: m.platform) AS platforms, coalesce(metrics, []) AS metrics, CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 50) / 1000.0::DOUBLE END AS direct
  FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN ctop ON k = c_custkey LEFT JOIN cmet ON creator = c_custkey)"""
BRANDS = """modal AS (SELECT c_nationkey AS nk, category FROM (SELECT c_nationkey, lower(c_mktsegment) AS category, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, lower(c_mktsegment)) AS r FROM customer GROUP BY c_nationkey, lower(c_mktsegment)) WHERE r = 1),
btop AS (SELECT k, list(p_name ORDER BY r) AS topics FROM (SELECT c_nationkey AS k, p_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, p_name) AS r FROM sold WHERE c_nationkey IS NOT NULL GROUP BY c_nationkey, p_name) WHERE r <= 4 GROUP BY k),
brands AS (
  SELECT n_nationkey AS brand_id, category, coalesce(topics, []) AS match_topics, list_filter(list_distinct([lower(n_name), coalesce(category, '')]), lambda x: x <> '') AS target_audience,
    ['sales', 'community', 'ugc awareness', 'lead demo pipeline'][n_nationkey % 4 + 1] AS goal,
    CASE n_nationkey % 3 WHEN 0 THEN ['youtube', 'tiktok'] WHEN 1 THEN ['instagram'] ELSE ['linkedin', 'youtube', 'x'] END AS preferred_platforms,
    list_filter(list_distinct(list_concat([category], topics[1:1])), lambda x: x IS NOT NULL) AS priorities
  FROM nation LEFT JOIN modal ON nk = n_nationkey LEFT JOIN btop ON k = n_nationkey)"""


def best(wanted: str, offered: str, likeness: str) -> str:
    return f"list_avg(list_transform({wanted}, lambda w: list_max(list_transform({offered}, lambda o: {likeness}))))"


def niche(a: str, b: str, what: str) -> str:
    values = {"score": ("0.0", "1.0", "0.75", "0.55", "0.0"), "confidence": ("0.1", "0.95", "0.8", "0.65", "0.85")}[what]
    return case((f"{a} = '' OR {b} = ''", values[0]), (f"{a} = {b}", values[1]), (f"contains({a}, {b}) OR contains({b}, {a})", values[2]), (f"{overlap(tokens(a), tokens(b))} >= 0.5", values[3]), otherwise=values[4])


TOPIC_LIKE = f"CASE WHEN w = o THEN 1.0 ELSE {jaccard(tokens('w'), tokens('o'))} END"
AUDIENCE_LIKE = f"CASE WHEN w = o THEN 1.0 ELSE {overlap(tokens('w'), tokens('o'))} END"
STRENGTH = f"""CASE WHEN NOT list_contains(platforms, w) THEN 0.0 ELSE {clamp(f'''0.35 + CASE WHEN coalesce(m.avg_views, 0) > 0 AND most > 0 THEN 0.35 * ln(1 + m.avg_views) / ln(1 + greatest(m.avg_views, most)) ELSE 0.18 * {clamp("ln(1 + m.followers) / ln(1 + 1e6)")} END
  + 0.2 * {clamp("m.engagement_rate / 0.07")} + 0.1 * {clamp("m.confidence")} + 0.06 * {clamp("m.sample_size / 6")}''')} END"""
WEIGHT = "greatest(0.2, m.confidence) * greatest(0.3, least(1.0, m.sample_size / 5)) * greatest(1.0, log10(m.followers + 10))"
FIT = f"""derived AS (
  SELECT *, list_filter(metrics, lambda m: m.engagement_rate > 0) AS rated FROM creators),
rates AS (
  SELECT *, CASE WHEN len(rated) > 0 THEN list_sum(list_transform(rated, lambda m: m.engagement_rate * {WEIGHT})) / list_sum(list_transform(rated, lambda m: {WEIGHT})) END AS rate,
    CASE WHEN len(rated) > 0 THEN {clamp("0.45 + 0.2 * least(1.0, len(rated) / 3.0) + 0.25 * list_avg(list_transform(rated, lambda m: m.confidence))")} ELSE 0.0 END AS rconf FROM derived),
fits AS (
  SELECT *, CASE WHEN direct IS NOT NULL AND rate IS NOT NULL THEN {clamp("(direct * 0.8 + rate * greatest(0.2, rconf)) / (0.8 + greatest(0.2, rconf)) / 0.045")} WHEN direct IS NOT NULL THEN {clamp("direct / 0.045")} WHEN rate IS NOT NULL THEN {clamp("rate / 0.045")} ELSE 0.0 END AS e_s,
    CASE WHEN direct IS NOT NULL AND rate IS NOT NULL THEN {clamp("0.55 + 0.25 * rconf")} WHEN direct IS NOT NULL THEN 0.86 WHEN rate IS NOT NULL THEN rconf ELSE 0.25 END AS e_c FROM rates)"""


def intent_hits(texts: str, keywords) -> str:
    return "(" + " + ".join(f"coalesce(list_sum(list_transform({texts}, lambda t: contains(t, {q(k)})::INT)), 0)" for k in keywords) + ")"


WANTED = "list_distinct(list_concat(match_topics, [goal]))"
INTENT = f"""intents AS (SELECT *, {WANTED} AS wanted, {', '.join(f"{intent_hits(WANTED, ks)} + {int(k == 'product_sale')} AS h_{k}" for k, ks in rules.INTENT_KEYWORDS.items())} FROM brands),
shares AS (SELECT *, {' + '.join(f'h_{k}' for k in rules.INTENT_KEYWORDS)} AS h FROM intents),
based AS (SELECT *, {', '.join('(' + ' + '.join(f'h_{k}::DOUBLE / h * {w[i]}' for k, w in rules.POLICIES.items()) + f') AS base_{m}' for i, m in enumerate(rules.MODULES))} FROM shares)"""
SIMILAR = f"CASE WHEN p = '' OR s = '' THEN 0.0 WHEN p = s THEN 1.0 WHEN contains(p, s) OR contains(s, p) THEN 0.84 ELSE {overlap(tokens('p'), tokens('s'))} END"


def boosted(priorities: str, offered: str) -> str:
    """A list of (likeness, -rank, priority) structs of what counts, best first."""
    rated = f"list_transform({priorities}, lambda p, i: struct_pack(a := coalesce(list_max(list_transform({offered}, lambda s: {SIMILAR})), 0.0), b := -i, c := p))"
    return f"list_reverse_sort(list_filter({rated}, lambda r: r.a >= 0.34))[1:3]"


PAIRS = f"""WITH {CREATORS}, {BRANDS}, {FIT}, {INTENT},
pairs AS (
  SELECT *, {niche('coalesce(category, {e})'.format(e="''"), 'niche', 'score')} AS n_s, {niche('coalesce(category, {e})'.format(e="''"), 'niche', 'confidence')} AS n_c,
    CASE WHEN len(wanted) = 0 OR len(topics) = 0 THEN 0.0 ELSE {best('wanted', 'topics', TOPIC_LIKE)} END AS t_s,
    CASE WHEN len(wanted) = 0 OR len(topics) = 0 THEN 0.2 ELSE {clamp('0.4 + 0.35 * least(1.0, len(wanted) / 4.0) + least(0.18, 0.02 * len(topics)) + 0.15 * 0.5')} END AS t_c,
    {best('target_audience', 'audience_types', AUDIENCE_LIKE)} AS a_s, {clamp('0.45 + 0.08 * least(4, len(target_audience)) + 0.15 * 0.5')} AS a_c,
    coalesce(list_max(list_transform(metrics, lambda m: m.avg_views)), 0) AS most,
    {boosted('priorities', 'list_distinct(list_concat([niche], topics, audience_types))')} AS top
  FROM fits CROSS JOIN based),
platformed AS (
  SELECT *, CASE WHEN len(platforms) = 0 THEN 0.0 ELSE {clamp(f"list_avg(list_transform(preferred_platforms, lambda w: coalesce(list_max(list_transform(list_filter(metrics, lambda m: m.platform = w), lambda m: {STRENGTH})), 0.0)))")} END AS p_s,
    CASE WHEN len(platforms) = 0 THEN 0.4 ELSE {clamp("0.35 + 0.58 * len(list_intersect(preferred_platforms, platforms))::DOUBLE / len(preferred_platforms) + 0.05 * least(1.0, len(preferred_platforms) / 4.0)")} END AS p_c,
    CASE WHEN len(top) > 0 THEN least(0.16, 0.04 * len(top) + 0.07 * list_avg(list_transform(top, lambda r: r.a))) ELSE 0.0 END AS boost
  FROM pairs),
weighed AS (SELECT *, base_niche * n_c + base_topic * t_c + base_platform * p_c + base_audience * a_c + base_engagement * e_c AS w FROM platformed),
scored AS (SELECT *, {rnd(clamp(clamp('(n_s * base_niche * n_c + t_s * base_topic * t_c + p_s * base_platform * p_c + a_s * base_audience * a_c + e_s * base_engagement * e_c) / w') + ' + boost'), 4)} AS total FROM weighed)"""


def module(s: str) -> str:
    return f"{PAIRS} SELECT brand_id, creator_id, {rnd(f'{s}_s')} AS score, {rnd(f'{s}_c')} AS confidence FROM scored"


ORACLES = {
    "score_niche_affinity": f"""WITH n AS (SELECT n_nationkey, ['building', 'auto mobile', 'machinery tools', 'household', 'furniture shop', ''][n_nationkey % 6 + 1] AS category FROM nation), c AS (SELECT c_custkey, lower(c_mktsegment) AS niche FROM customer)
      SELECT n_nationkey, c_custkey, ({niche('category', 'niche', 'score')})::DOUBLE AS score, ({niche('category', 'niche', 'confidence')})::DOUBLE AS confidence FROM c CROSS JOIN n""",
    "score_topic_similarity": module("t"), "score_audience_fit": module("a"), "score_platform_alignment": module("p"),
    "score_engagement_fit": f"WITH {CREATORS}, {FIT} SELECT creator_id, {rnd('e_s')} AS score, {rnd('e_c')} AS confidence FROM fits",
    "match_total_top12": f"""{PAIRS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY brand_id ORDER BY total DESC, creator_id) AS rank FROM scored)
      SELECT brand_id, creator_id, rank, total, {pipe(picked(('n_s * n_c >= 0.15', 'niche'), ('t_s * t_c >= 0.15', 'topic'), ('p_s * p_c >= 0.15', 'platform'), ('a_s * a_c >= 0.15', 'audience'), ('e_s * e_c >= 0.15', 'engagement'), ('boost > 0', 'priority')))} AS reasons, platforms[1] AS best_platform FROM ranked WHERE rank <= 12""",
    "priority_boost_top3": f"""WITH p AS (SELECT p_partkey, {boosted("['small ring', 'ring', 'large bolt', 'economy', 'promo gear']", f"list_distinct([{phrase('p_name')}, {phrase('p_type')}])")} AS top FROM part)
      SELECT p_partkey, {rnd("CASE WHEN len(top) > 0 THEN least(0.16, 0.04 * len(top) + 0.07 * list_avg(list_transform(top, lambda r: r.a))) ELSE 0.0 END")} AS boost, {pipe('list_transform(top, lambda r: r.c)')} AS matched FROM p""",
    "policy_blend_reweight": f"""WITH {SOLD}, {BRANDS}, {INTENT}, t AS (SELECT *, base_niche * 0.95 + base_topic * 0.4 + base_platform * 0.675 + base_audience * 0.61 AS w FROM based)
      SELECT brand_id, {', '.join(f"{rnd(f'base_{m}')} AS base_{m}" for m in rules.MODULES)}, {', '.join(f"{rnd(f'base_{m} * {c} / w')} AS weight_{m}" for m, c in zip(rules.MODULES, (0.95, 0.4, 0.675, 0.61, 0.0), strict=True))} FROM t""",
    "intent_vector": f"""WITH c AS (SELECT conv_id, turn, list_distinct([{phrase("concat_ws(' ', 'community lead sales', role, text)")}, 'brand awareness', {phrase('text')}]) AS texts FROM conversations),
      h AS (SELECT *, {', '.join(f"{intent_hits('texts', ks)} + {int(k == 'product_sale')} AS h_{k}" for k, ks in rules.INTENT_KEYWORDS.items())} FROM c)
      SELECT conv_id, turn, {', '.join(rnd(f"h_{k}::DOUBLE / ({' + '.join(f'h_{j}' for j in rules.INTENT_KEYWORDS)})") + f' AS {k}' for k in rules.INTENT_KEYWORDS)} FROM h""",
    "match_upsert_keeps_status": """SELECT o_orderkey, CASE WHEN o_totalprice >= 100000 THEN o_totalprice * 2 ELSE o_totalprice END AS score, CASE WHEN o_totalprice < 200000 THEN o_orderstatus ELSE 'new' END AS status FROM orders""",
    "pool_cascade": """WITH c AS (SELECT c_custkey AS id, c_acctbal AS at FROM customer), s AS (SELECT s_suppkey AS id, s_acctbal AS at FROM supplier), top AS (SELECT max("at") AS m FROM c),
      a AS (SELECT 'pipeline' AS pool, id, "at" FROM c, top WHERE "at" > m UNION ALL SELECT 'identity', id, "at" FROM s WHERE "at" < 0 AND NOT EXISTS (FROM c, top WHERE "at" > m) UNION ALL SELECT 'all', id, "at" FROM c WHERE NOT EXISTS (FROM s WHERE "at" < 0)),
      r AS (SELECT 'fallen' AS run, * FROM a ORDER BY "at" DESC NULLS LAST, id LIMIT 500), b AS (SELECT 'asked' AS run, 'all' AS pool, * FROM c ORDER BY "at" DESC NULLS LAST, id LIMIT 500) SELECT * FROM r UNION ALL SELECT * FROM b""",
    "unlinked_anti_join": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (FROM orders WHERE o_custkey = c_custkey)",
    "not_exists_import": "SELECT c_custkey, c_acctbal FROM customer WHERE NOT EXISTS (FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 100000) AND coalesce(c_acctbal, 0) >= 0.35",
    "exists_semi": "SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "exists_mark_column": "SELECT c_custkey, EXISTS (FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS already_imported FROM customer",
    "cross_platform_handle_candidate": f"""WITH {SIGNALS}, a AS (SELECT event_id AS account, creator AS handle, platform FROM signals WHERE event_id % 10 = 0), l AS (SELECT * FROM signals WHERE event_id % 10 <> 0),
      b AS (SELECT account, event_id AS candidate FROM (SELECT account, event_id, row_number() OVER (PARTITION BY account ORDER BY ts DESC, event_id DESC) AS r FROM a JOIN l ON handle = creator AND l.platform <> a.platform) WHERE r = 1)
      SELECT a.*, candidate, CASE WHEN candidate IS NULL THEN 0.3 ELSE 0.55 END::DOUBLE AS confidence FROM a LEFT JOIN b USING (account)""",
    "import_agg_cte": f"""WITH {MEASURED}, o AS (SELECT o_custkey, string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) AS statuses, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY 1),
      m AS (SELECT creator, string_agg(platform || ':' || followers::BIGINT || ':' || sample_size::BIGINT, '|' ORDER BY platform) AS metrics, avg(confidence) AS confidence FROM measured GROUP BY 1)
      SELECT c_custkey, statuses, priorities, metrics, {rnd('confidence')} AS confidence FROM customer LEFT JOIN o ON o_custkey = c_custkey LEFT JOIN m ON creator = c_custkey""",
    "group_platform_signals": f"WITH {SIGNALS} SELECT creator, platform, max(followers) AS followers, count(*) AS signal_count FROM signals GROUP BY ALL",
    "coverage_report": f"""WITH p AS (SELECT CASE page_id % 4 WHEN 0 THEN 'tiktok' WHEN 1 THEN 'youtube' WHEN 2 THEN 'x' ELSE 'unknown' END AS platform, contains(url, 'utm') AS s FROM pages)
      SELECT count(*) AS total, count(*) FILTER (s) AS with_slug, {', '.join(f"count(*) FILTER (platform = '{p}') AS n_{p}" for p in rules.PLATFORMS)}, {rnd('100.0 * count(*) FILTER (s) / count(*)', 2)}::DOUBLE AS pct FROM p""",
    "page_stats_global": "SELECT count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest FROM events",
    "explorer_union_priority": """SELECT * FROM (SELECT 'synthetic' AS source, s_suppkey AS id, s_acctbal AS at, 'supplier' AS label, 0 AS priority FROM supplier
      UNION ALL SELECT 'real', c_custkey, c_acctbal, coalesce(nullif(c_mktsegment, ''), 'none'), 1 FROM customer) ORDER BY priority, "at" DESC NULLS LAST, id LIMIT 500""",
    "explorer_search_filter": "SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE contains(lower(concat_ws(' ', c_custkey, c_name, c_mktsegment, n_name)), 'build')",
    "niche_group_histogram": f"""WITH n AS (SELECT ['fitness', 'ai tools', 'pets', 'b2b saas', 'travel', 'skincare', 'home & decor', 'unheard of'][p_partkey % 8 + 1] AS n FROM part),
      g AS (SELECT {case(*[(' OR '.join(f"contains(n, {q(x)}) OR contains({q(x)}, n)" for x in labels), q(group)) for group, labels in rules.NICHE_GROUPS], otherwise="'Business'")} AS niche_group FROM n)
      SELECT position::INT AS position, d.niche_group, count(g.niche_group) AS n FROM (VALUES {', '.join(f'({i}, {q(g)})' for i, (g, _) in enumerate(rules.NICHE_GROUPS))}) d(position, niche_group) LEFT JOIN g USING (niche_group) GROUP BY ALL""",
    "available_platforms": f"WITH {SIGNALS} SELECT DISTINCT position::INT AS position, platform FROM signals JOIN (VALUES (0, 'instagram'), (1, 'tiktok'), (2, 'youtube'), (3, 'x'), (4, 'linkedin')) d(position, platform) USING (platform)",
    "est_price_budget_filter": f"""WITH {MEASURED}, m AS (SELECT creator, floor(avg(avg_views) FILTER (avg_views > 0) + 0.5)::BIGINT AS v, sum(followers) FILTER (followers > 0)::BIGINT AS f FROM measured GROUP BY 1),
      c AS (SELECT c_custkey, ['fitness', 'personal finance', 'b2b saas', 'beauty', 'ecommerce', 'pets'][c_custkey % 6 + 1] AS niche, v AS avg_views, f AS followers_total FROM customer JOIN m ON creator = c_custkey),
      p AS (SELECT *, floor(avg_views / 1000 * ({case(*[(f"regexp_matches(niche, '{w}')", f'{r}.0') for w, r in rules.CPM], otherwise=f'{rules.CPM_OTHERWISE}.0')})::DOUBLE + 0.5)::BIGINT AS price FROM c WHERE avg_views > 0)
      SELECT * FROM p WHERE price <= 500 * 1.1""",
    "latest_per_key": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1",
    "first_wins_dedup": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1",
    "move_rows_between_tables": """SELECT 'source' AS side, c_custkey AS id, c_acctbal AS balance, NULL::VARCHAR AS origin FROM customer WHERE NOT coalesce(c_acctbal < 0, FALSE)
      UNION ALL SELECT 'target', c_custkey, c_acctbal, CASE WHEN c_custkey % 4 = 0 THEN 'old' ELSE 'migrated_from_creators' END FROM customer WHERE c_custkey % 4 = 0 OR c_acctbal < 0""",
    "brand_page_bundle": """WITH d AS (SELECT source, substring(text, 1, 8000) AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
      b AS (SELECT source, substring(string_agg(t, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY r), 1, 13000) AS bundle FROM d WHERE r <= 6 GROUP BY source) SELECT source, md5(bundle) AS bundle_md5, length(bundle) AS n FROM b""",
    "brand_dossier_merge": """SELECT s_suppkey AS id, array_to_string(list_concat(['Sales', s_name], CASE WHEN s_suppkey % 2 = 0 THEN ['reach'] ELSE [] END), '|') AS goals,
      CASE WHEN contains(s_name, 'Supplier#000000001') THEN 'About ' || s_name ELSE 'About ' || s_name || ' Supplier#000000001' END AS summary FROM supplier""",
    "coalesce_order_limit": """WITH l AS (SELECT o_custkey, max(o_totalprice) AS a FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
      SELECT c_custkey, coalesce(a, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END) AS at FROM customer LEFT JOIN l ON o_custkey = c_custkey ORDER BY "at" DESC NULLS FIRST, c_custkey LIMIT 200""",
    "session_events": f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, {rnd('sum(value)', 4)} AS total FROM events GROUP BY ALL",
}

# URLs and text.
HOST_PARTS = "'^\\s*([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]+)?([^?#]*)(\\?[^#]*)?(#.*)?$'"
FORMS = ("https://www.instagram.com/p/a%d", "https://www.tiktok.com/@a%d/video/1", "https://uk.linkedin.com/in/jo-%d", "https://twitter.com/Home", "https://x.com/u_%d?si=1", "https://youtu.be/v%d", "https://www.youtube.com/watch?v=q%d&t=3", "https://m.youtube.com/@c%d#about", "https://www.youtube.com/channel/UC%d")
ODD = "odd AS (SELECT page_id, url AS page_url, CASE page_id % 10 " + " ".join(f"WHEN {i} THEN replace({q(f)}, '%d', page_id::VARCHAR)" for i, f in enumerate(FORMS)) + " ELSE url END AS url FROM pages)"


def part(u: str, n: int) -> str:
    return f"regexp_extract({u}, {HOST_PARTS}, {n})"


#: f: accounts one after the other (i from 1), with what has been opened so far.
FOLD = f"""a AS (SELECT row_number() OVER (ORDER BY page_id) AS i, page_id, CASE WHEN page_id % 3 <> 0 THEN list_filter(string_split({part('url', 3)}, '/'), lambda x: x <> '')[2] END AS slug, CASE WHEN page_id % 5 <> 0 THEN regexp_replace(lower({part('url', 2)}), '^www\\.', '') END AS domain FROM pages),
      f AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS page_id, NULL::VARCHAR AS slug, NULL::VARCHAR AS domain, NULL::VARCHAR AS anchor, []::VARCHAR[] AS slugs, []::VARCHAR[] AS domains, []::VARCHAR[] AS held
        UNION ALL SELECT i, page_id, slug, domain, anchor, CASE WHEN opens AND slug IS NOT NULL THEN list_append(slugs, slug) ELSE slugs END, CASE WHEN opens AND domain IS NOT NULL THEN list_append(domains, domain) ELSE domains END, CASE WHEN opens AND domain IS NOT NULL THEN list_append(held, anchor) ELSE held END
        FROM (SELECT *, CASE WHEN s THEN 's:' || slug WHEN d THEN held[list_position(domains, domain)] WHEN slug IS NOT NULL THEN 's:' || slug ELSE 'd:' || domain END AS anchor, NOT s AND NOT d AND (slug IS NOT NULL OR domain IS NOT NULL) AS opens
          FROM (SELECT a.*, f.slugs, f.domains, f.held, coalesce(list_contains(f.slugs, a.slug), FALSE) AS s, coalesce(list_contains(f.domains, a.domain), FALSE) AS d FROM f JOIN a ON a.i = f.i + 1)))"""


def on(h: str, *names: str) -> str:
    return "(" + " OR ".join(f"{h} = {q(n)} OR ends_with({h}, {q('.' + n)})" for n in names) + ")"


SPLIT = f"""{ODD}, split AS (SELECT *, lower({part('url', 2)}) AS h, list_filter(string_split({part('url', 3)}, '/'), lambda x: x <> '') AS parts, {part('url', 4)} AS search FROM odd),
kinds AS (SELECT *, CASE WHEN {on('h', 'x.com', 'twitter.com')} THEN 'x' WHEN {on('h', 'instagram.com')} THEN 'instagram' WHEN {on('h', 'linkedin.com')} THEN 'linkedin' WHEN {on('h', 'tiktok.com')} THEN 'tiktok' WHEN {on('h', 'youtube.com', 'youtu.be')} THEN 'youtube' ELSE 'unknown' END AS platform FROM split),
profiles AS (SELECT *, 'https://' || regexp_replace(h, '^www\\.', '') || '/' || CASE
    WHEN platform = 'x' AND lower(parts[1]) NOT IN ('home', 'search', 'explore', 'i', 'intent') THEN parts[1]
    WHEN platform = 'instagram' AND parts[1] NOT IN ('p', 'reel', 'explore') THEN parts[1]
    WHEN platform = 'linkedin' AND lower(parts[1]) IN ('in', 'company') AND len(parts) > 1 THEN lower(parts[1]) || '/' || parts[2]
    WHEN platform = 'tiktok' AND starts_with(parts[1], '@') THEN parts[1]
    WHEN platform = 'youtube' AND ends_with(h, 'youtu.be') THEN parts[1]
    WHEN platform = 'youtube' AND starts_with(parts[1], '@') THEN parts[1]
    WHEN platform = 'youtube' AND lower(parts[1]) IN ('channel', 'c', 'user') AND len(parts) > 1 THEN lower(parts[1]) || '/' || parts[2]
    WHEN platform = 'youtube' AND lower(parts[1]) = 'watch' AND regexp_matches(search, '[?&]v=[^&]+') THEN 'watch?v=' || regexp_extract(search, '[?&]v=([^&]+)', 1) END AS profile FROM kinds)"""
WORDS = ("Book a call about coaching", "buy my course and template", "join the community newsletter", "DM me", "a guide for gym beginners", "ugc service, $1,500 per video", "nothing here", "cpm deal on tiktok and youtube for awareness")
TALK = f"talk AS (SELECT conv_id, turn, [{', '.join(map(q, WORDS))}][(conv_id + turn) % 8 + 1] || '. ' || coalesce(text, '') AS text FROM conversations)"


def cta(variant: str) -> str:
    from .functions.text import CTA_RULES

    return case(*[(word("lower(text)", w), q(v)) for w, v in CTA_RULES[variant]], otherwise="'generic'")


def types(variant: str) -> str:
    from .functions.text import PRODUCT_RULES

    return picked(*[(word("lower(text)", w), v) for w, v in PRODUCT_RULES[variant]])


def bare(u: str, names: str) -> str:
    """u without fragment and the named parameters."""
    base, search = f"regexp_extract({u}, '^[^?#]*')", f"regexp_extract({u}, '\\?([^#]*)', 1)"
    kept = f"list_filter(string_split({search}, '&'), lambda kv: kv <> '' AND NOT regexp_full_match(lower(regexp_extract(kv, '^[^=]*')), '{names}'))"
    return f"{base} || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END"


COUNT = "regexp_extract_all(replace(lower(said), ',', ''), '(?:^|[^A-Za-z0-9_])([0-9]+(?:\\.[0-9]+)?)\\s*([kmb])?\\+?\\s*(?:followers?|subscribers?|subs?)(?:[^A-Za-z0-9_]|$)', {n})"
LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '')"
MONEY = "'\\$\\s?[0-9]{1,3}(?:,[0-9]{3})*(?:\\.[0-9]{2})?'"
EMAIL = "'(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}'"


def hits(words) -> str:
    return "(" + " + ".join(f"({has('t', w)})::INT" for w in words) + ")"


def found(table) -> str:
    return picked(*[(f"{hits(w)} > 0", v) for v, w in table])


def texts(values) -> str:
    return "([" + ", ".join(map(q, values)) + "]::VARCHAR[])"


NICHES = f"""scored AS (SELECT *, [{', '.join(f'{hits(w)}::DOUBLE / {len(w)}' for _, w, _, _ in rules.NICHES)}] AS s FROM low),
best AS (SELECT *, list_max(s) AS top, CASE WHEN list_max(s) > 0 THEN list_position(s, list_max(s)) ELSE {[r[0] for r in rules.NICHES].index(rules.DEFAULT_NICHE) + 1} END AS i FROM scored),
signed AS (SELECT *, {found(rules.TOPICS)} AS t1, {found(rules.AUDIENCES)} AS a1, {found(rules.PRODUCTS)} AS p1, {found(rules.INTENTS)} AS i1, {cta('baseline')} AS cta FROM best),
styled AS (SELECT *, CASE WHEN cta = 'consultative' THEN 'consultative' WHEN cta = 'transactional' THEN 'direct_response' WHEN cta = 'community' THEN 'community_led' WHEN cta = 'inbound_dm' THEN 'dm_conversion'
  WHEN list_contains(i1, 'direct_purchase') THEN 'direct_response' WHEN list_contains(i1, 'lead_generation') THEN 'consultative' WHEN list_contains(i1, 'community') THEN 'community_led' ELSE 'educational' END AS style FROM signed)"""


def uniq(xs: str) -> str:
    return f"list_filter({xs}, lambda x, n: list_position({xs}, x) = n)"


ALL_TOPICS = f"list_concat(([{', '.join(texts(r[2]) for r in rules.NICHES)}])[i], t1, p1, list_transform(i1, lambda x: replace(x, '_', ' ')))"
ALL_AUDIENCES = f"list_concat(([{', '.join(texts(r[3]) for r in rules.NICHES)}])[i], a1)"
OFFERS = "(list_concat(['my course'], list_filter(" + LINES.replace("string_split(text,", "string_split(replace(text, '. ', chr(10)),") + ", lambda s: length(s) BETWEEN 5 AND 90)))"
OFFER_TEST = word("lower(o)", "course|program|coaching|template|ebook|guide|membership|newsletter|workshop|bundle|service|1:1")
PLAIN = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>', '', 'g'), '(?i)<(br|/p|/h[1-6]|/li|/div|/title|/article|/footer|/nav)[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g')"
for _name, _sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
    PLAIN = f"replace({PLAIN}, '{_name}', '{_sign}')"
PLAIN = f"substring(regexp_replace(regexp_replace(regexp_replace({PLAIN}, '[ \\t]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g'), 1, 120000)"
VIEWS = {p: v for p, v in rules.VIEW_RATE.items()}


def prior(table) -> str:
    return case(*[(f"platform = '{p}'", f"{v}::DOUBLE") for p, v in table.items()])


ORACLES |= {
    "url_platform_detect": f"WITH {SPLIT} SELECT page_id, h AS host, platform FROM kinds",
    "url_normalize": f"WITH {SPLIT} SELECT page_id, url, profile FROM profiles",
    "url_handle": f"""WITH {SPLIT}, p AS (SELECT page_id, platform, list_filter(string_split({part('profile', 3)}, '/'), lambda x: x <> '') AS s, profile FROM profiles)
      SELECT page_id, CASE WHEN profile IS NULL THEN NULL WHEN platform = 'linkedin' THEN s[2] WHEN platform = 'youtube' AND s[1] IN ('channel', 'c', 'user') THEN s[2] ELSE regexp_replace(s[1], '^@', '') END AS handle FROM p""",
    "url_canonicalize": f"WITH {ODD} SELECT page_id, {bare('url', 'utm_|fbclid|gclid|si')} AS canonical, {bare('page_url', 'utm_|fbclid|gclid|si')} AS page_canonical, {bare('page_url', 'utm_.*|fbclid|gclid|si')} AS page_stripped FROM odd",
    "url_brand_name": f"""SELECT page_id, array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_extract(regexp_replace(lower({part('url', 2)}), '^www\\.', ''), '^[^.]*'), '[-_]'), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), ' ') AS brand, TRUE AS is_page, FALSE AS is_search FROM pages""",
    "serp_dedup_caps": f"""WITH p AS (SELECT page_id, 'a' || page_id % 3 AS agent, 'q' || page_id % 7 AS query, {bare('url', 'utm_|fbclid|gclid|si')} AS c FROM pages WHERE {on(f"lower({part('url', 2)})", 'example.com', 'example.org')}),
      o AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY agent, c ORDER BY page_id) = 1), r AS (SELECT *, row_number() OVER (PARTITION BY agent, query ORDER BY page_id) AS rank FROM o)
      SELECT page_id, agent, query, rank FROM r WHERE rank <= 10 QUALIFY row_number() OVER (PARTITION BY agent ORDER BY query, rank) <= 20""",
    "html_title": "SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages",
    "html_to_text": f"SELECT page_id, md5({PLAIN}) AS text_md5, length({PLAIN}) AS n FROM pages",
    "html_links_interesting": f"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') AS site, regexp_replace(regexp_extract(url, '^[^?#]*'), '[^/]*$', '') AS folder, page_id % 3 AS k FROM pages)
      SELECT page_id, CASE WHEN k <> 2 THEN site || '/pricing|' ELSE '' END || CASE WHEN k = 1 THEN folder || 'about-' || page_id || '|' ELSE '' END || site || '/blog#x' || CASE WHEN k = 0 THEN '|' || site || '/company?p=' || page_id ELSE '' END AS links FROM p""",
    "bot_challenge_flag": f"WITH p AS (SELECT page_id, lower(html || CASE WHEN page_id % 3 = 0 THEN 'Attention Required! | Cloudflare' ELSE '' END) AS h FROM pages) SELECT page_id, ({' + '.join(f'contains(h, {q(m)})::INT' for m in rules.CHALLENGE_MARKS)}) >= 2 AS challenged FROM p",
    "text_emails": f"SELECT doc_id, {pipe(f'list_sort(list_distinct(regexp_extract_all(text, {EMAIL})))')} AS emails FROM documents",
    "text_money": f"SELECT doc_id, {pipe(f"list_sort({uniq(f"list_transform(regexp_extract_all(text || ' $ 1,200.50 or $1,200.50 and $9', {MONEY}), lambda p: replace(p, ' ', ''))")}[1:30])")} AS prices FROM documents",
    "cta_style": f"WITH {TALK} SELECT conv_id, turn, {cta('baseline')} AS baseline, {cta('page')} AS page FROM talk",
    "product_types": f"WITH {TALK} SELECT conv_id, turn, {pipe(types('baseline'))} AS baseline, {pipe(types('page'))} AS page FROM talk",
    "offer_candidates": f"WITH {TALK}, o AS (SELECT conv_id, turn, list_filter({OFFERS}, lambda o: {OFFER_TEST}) AS o FROM talk) SELECT conv_id, turn, {pipe(uniq('o') + '[1:25]')} AS offers FROM o",
    "bio_lines": f"WITH b AS (SELECT doc_id, list_filter({LINES}, lambda s: length(s) > 20 AND length(s) < 220) AS s FROM documents) SELECT doc_id, CASE WHEN len(s) > 0 THEN array_to_string(s[1:2], ' ') END AS bio FROM b",
    "follower_count_parse": f"""WITH p AS (SELECT p_partkey, p_name || ' has ' || p_size || CASE p_partkey % 3 WHEN 0 THEN '.5k+ followers' WHEN 1 THEN ',200 subscribers' ELSE 'm views' END || ' and 3 subs' AS said FROM part),
      n AS (SELECT p_partkey, {COUNT.format(n=1)} AS n, {COUNT.format(n=2)} AS s FROM p),
      v AS (SELECT p_partkey, list_transform(n, lambda x, i: floor(x::DOUBLE * CASE s[i] WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'b' THEN 1e9 ELSE 1 END + 0.5)::BIGINT) AS v FROM n)
      SELECT p_partkey, v[1] AS first, list_max(v[1:12]) AS most FROM v""",
    "keyword_rules_niche": f"""WITH {TALK}, low AS (SELECT *, lower(text) AS t FROM talk), {NICHES}
      SELECT conv_id, turn, {texts(r[0] for r in rules.NICHES)}[i] AS niche, {rnd(clamp('0.35 + top * 1.3', '0.25', '0.98'), 3)} AS niche_confidence, {pipe(uniq(ALL_TOPICS) + '[1:12]')} AS topics, {pipe(uniq(ALL_AUDIENCES) + '[1:8]')} AS audiences,
        {pipe('p1')} AS products, {pipe('i1')} AS intents, style AS selling_style,
        CASE style WHEN 'consultative' THEN 'consultative coaching-style content' WHEN 'direct_response' THEN 'direct response offer-led content' WHEN 'community_led' THEN 'community and newsletter-led content' WHEN 'dm_conversion' THEN 'personal brand and DM-led conversion content'
          ELSE CASE WHEN list_contains(t1, 'ugc content') THEN 'ugc demonstration content' ELSE 'educational creator content' END END AS content_style,
        {rnd(clamp("0.3::DOUBLE + CASE WHEN len(p1) >= 1 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN len(p1) >= 3 THEN 0.06::DOUBLE ELSE 0 END + CASE WHEN list_contains(i1, 'direct_purchase') THEN 0.14::DOUBLE ELSE 0 END + CASE WHEN list_contains(i1, 'lead_generation') THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN list_contains(i1, 'affiliate') THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN style IN ('direct_response', 'consultative') THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN contains(text, '$') THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN conv_id % 2 = 0 THEN 0.07::DOUBLE ELSE 0 END + CASE WHEN conv_id % 3 = 0 THEN 0.04::DOUBLE ELSE 0 END", '0.1', '0.98'), 3)}::DOUBLE AS buying_intent FROM styled""",
    "store_confidence": f"""WITH {TALK}, h AS (SELECT conv_id, turn, len(list_filter(list_filter({LINES}, lambda s: length(s) BETWEEN 5 AND 90), lambda o: {OFFER_TEST})) > 0 AS offers, len(regexp_extract_all(text, {MONEY})) > 0 AS prices, len({types('baseline')}) > 0 AS types, len(regexp_extract_all(text, {EMAIL})) > 0 AS email, contains(text, 'tiktok') AS socials FROM talk)
      SELECT conv_id, turn, {rnd("0.25::DOUBLE + offers::INT * 0.2::DOUBLE + prices::INT * 0.2::DOUBLE + types::INT * 0.15::DOUBLE + email::INT * 0.1::DOUBLE + socials::INT * 0.1::DOUBLE", 2)} AS baseline,
        {rnd("0.25::DOUBLE + offers::INT * 0.16::DOUBLE + prices::INT * 0.14::DOUBLE + types::INT * 0.13::DOUBLE + socials::INT * 0.1::DOUBLE + email::INT * 0.07::DOUBLE", 3)} AS page FROM h""",
    "social_signal_estimate": f"""WITH {SIGNALS}, g AS (SELECT creator, platform, max(followers) AS f, count(*) AS n, creator % 2 = 0 AS o FROM signals GROUP BY creator, platform), k AS (SELECT *, coalesce(f > 0, FALSE) AS has FROM g WHERE NOT coalesce(f > 0 AND f < 100, FALSE))
      SELECT creator, platform, CASE WHEN has THEN f END AS followers, CASE WHEN has THEN greatest(1, floor(f * {prior(VIEWS)} * least(1.3::DOUBLE, 0.9::DOUBLE + n * 0.08::DOUBLE) + 0.5))::BIGINT END AS avg_views,
        {rnd(clamp(f"{prior(rules.ENGAGEMENT)} + least(0.02::DOUBLE, greatest(0, n - 1) * 0.003::DOUBLE) + CASE WHEN o THEN 0.002::DOUBLE ELSE 0 END", '0.008', '0.2'), 4)} AS engagement_rate, greatest(n, o::INT)::BIGINT AS sample_size,
        CASE WHEN has AND n >= 2 THEN 'estimated_multi_signal' WHEN has THEN 'estimated_single_signal' WHEN o THEN 'platform_presence_only' ELSE 'sparse' END AS quality,
        {clamp(rnd("0.24::DOUBLE + CASE WHEN platform <> 'unknown' THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN has THEN 0.34::DOUBLE ELSE 0 END + CASE WHEN n >= 2 THEN 0.14::DOUBLE ELSE 0 END + CASE WHEN n >= 4 THEN 0.06::DOUBLE ELSE 0 END + CASE WHEN o THEN 0.12::DOUBLE ELSE 0 END + CASE WHEN has THEN 0.1::DOUBLE ELSE 0 END", 3), '0.2', '0.95')}::DOUBLE AS confidence FROM k""",
    "weighted_engagement": f"""WITH {MEASURED} SELECT creator, {rnd('sum(engagement_rate * greatest(0.2, confidence) * log10(followers + 10)) / sum(greatest(0.2, confidence) * log10(followers + 10))', 4)} AS enriched,
      {rnd('sum(engagement_rate * greatest(0.2, confidence) * greatest(1.0, log10(followers + 10))) / sum(greatest(0.2, confidence) * greatest(1.0, log10(followers + 10)))', 4)} AS imported FROM measured GROUP BY 1""",
    "primary_platform_argmax": f"""WITH {MEASURED}, s AS (SELECT *, {rnd('log10(greatest(1.0, avg_views + 1)) * 0.5 + log10(greatest(1.0, followers + 1)) * 0.35 + confidence * 0.15', 9)} AS s FROM measured)
      SELECT creator, platform AS primary_platform FROM s QUALIFY row_number() OVER (PARTITION BY creator ORDER BY s DESC, platform) = 1""",
    "phrase_likeness": """WITH a AS (SELECT DISTINCT lower(p_name) AS a FROM part), b AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1) || ' ' || p_type) AS b FROM part),
      t AS (SELECT a, b, list_distinct(list_filter(regexp_split_to_array(a, '[^a-z0-9]+'), lambda x: x <> '')) AS ta, list_distinct(list_filter(regexp_split_to_array(b, '[^a-z0-9]+'), lambda x: x <> '')) AS tb FROM a, b),
      n AS (SELECT *, len(list_intersect(ta, tb)) AS n FROM t),
      m AS (SELECT unnest(['jaccard', 'overlap', 'phrase']) AS kind, a, b, unnest([CASE WHEN a = b THEN 1.0 ELSE n / (len(ta) + len(tb) - n) END, CASE WHEN a = b THEN 1.0 ELSE n / least(len(ta), len(tb)) END,
        CASE WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN 0.84 ELSE n / least(len(ta), len(tb)) END]) AS v FROM n)
      SELECT kind, a, b, floor(v * 1000000 + 0.5) / 1000000 AS likeness FROM m WHERE v >= 0.34""",
    "identity_resolve_fold": f"""WITH RECURSIVE {FOLD} SELECT page_id, slug, domain, 'ci_' || sha256(length(anchor) || ':' || anchor) AS identity_id FROM f WHERE i > 0""",
    "identity_resolve_fast": f"""WITH a AS (SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN 's' || page_id // 2 WHEN page_id % 5 <> 0 THEN regexp_replace(lower({part('url', 2)}), '^www\\.', '') END AS anchor FROM pages), f AS (SELECT anchor, min(page_id) AS first_account FROM a WHERE anchor IS NOT NULL GROUP BY 1)
      SELECT page_id, anchor, first_account FROM a LEFT JOIN f USING (anchor)""",    "intent_parse_free_text": f"""WITH {TALK}, low AS (SELECT *, lower(text) AS t, replace(text, ',', '') AS b FROM talk), u AS (SELECT *, CASE WHEN regexp_matches(t, '(per|/)\\s*(1k|1000)(\\s*views?)?') THEN 'per_1k_views' WHEN regexp_matches(t, 'per\\s*post') THEN 'per_post' WHEN regexp_matches(t, 'per\\s*video') THEN 'per_video' END AS per,
        {case((word('t', 'hybrid'), "'hybrid'"), (word('t', 'rev(enue)?\\s*share|commission'), "'rev_share'"), ("regexp_matches(t, '(^|[^a-z0-9_])cpm|per\\s*(1k|1000|thousand)|/\\s*(1k|1000)(\\s*views?)?')", "'cpm'"), (word('t', 'flat\\s*fee|fixed\\s*fee'), "'flat_fee'"))} AS compensation, regexp_matches(t, 'no fixed budget|no budget|open budget|flexible budget|budget tbd') AS open_budget FROM low)
      SELECT conv_id, turn, {case(*[(word('t', w), q(v)) for w, v in rules.PARTNERSHIP_WORDS])} AS partnership, compensation, coalesce(per, CASE WHEN compensation = 'cpm' THEN 'per_1k_views' END) AS unit,
        CASE WHEN NOT open_budget THEN coalesce(floor(TRY_CAST(nullif(regexp_extract(b, '\\$\\s*([0-9]+(?:\\.[0-9]+)?)', 1), '') AS DOUBLE) + 0.5)::BIGINT, CASE WHEN regexp_matches(lower(b), '(budget|pay|price|cost|spend|fee|per\\s*(video|post|1k|1000)|cpm)') THEN TRY_CAST(nullif(regexp_extract(b, '(?:^|[^A-Za-z0-9_])([0-9]{{2,6}})(?:\\.[0-9]+)?(?:[^A-Za-z0-9_]|$)', 1), '') AS BIGINT) END) END AS amount,
        open_budget, {pipe(picked(*[(word('t', w), g) for w, g in rules.GOAL_WORDS]))} AS goals, {pipe(picked(*[(word('t', w), p) for p, w in rules.PLATFORM_WORDS]))} AS platforms FROM u""",
}

ORACLES["extraction_stats"] = f"""WITH {SPLIT}, x AS (SELECT page_id, platform, profile, page_id % 4 AS k FROM profiles WHERE page_id % 11 <> 0),
  y AS (SELECT *, k IN (0, 3) AS slug, k IN (1, 3) AS followers, profile IS NOT NULL AS p FROM x),
  z AS (SELECT *, {rnd("0.1::DOUBLE + CASE WHEN slug THEN 0.38::DOUBLE ELSE 0 END + CASE WHEN followers THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN p THEN 0.26::DOUBLE ELSE 0 END + CASE WHEN p AND platform = 'instagram' THEN 0.06::DOUBLE ELSE 0 END", 3)} AS c FROM y)
  SELECT (SELECT count(*) FROM pages) AS processed, count(*) FILTER (slug) AS with_slug, count(*) FILTER (followers) AS with_followers, count(*) FILTER (p) AS with_profile, count(*) FILTER (p) AS with_handle, count(*) FILTER (platform = 'unknown') AS unknown_platform,
    count(*) FILTER (c >= 0.5) AS confident, (SELECT count(*) FROM pages WHERE page_id % 11 = 0) AS failed FROM z"""
