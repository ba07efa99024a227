"""DuckDB SQL for the queries of the flows."""

from __future__ import annotations

from .oracles import ALL_AUDIENCES, ALL_TOPICS, BRANDS, CREATORS, FOLD, MEASURED, NICHES, PAIRS, SIGNALS, SOLD, SPLIT, WORDS, clamp, part, pipe, prior, q, rnd, uniq
from .plans import rules


def pick(number: str, values) -> str:
    """The value at number modulo how many there are."""
    return f"CASE ({number}) % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


K = "json_extract_string(props, '$.k')"
MATCHES = "m AS (SELECT o_custkey % 25 AS brand_id, o_custkey AS creator_id, o_totalprice AS score, o_orderstatus AS status, o_orderkey AS match_id FROM orders)"

STORES = "stores AS (SELECT page_id AS identity_id, page_id AS k, CASE WHEN page_id % 9 <> 4 THEN 'store-' || page_id END AS slug, CASE WHEN page_id % 9 = 4 THEN 'skipped' WHEN page_id % 11 = 0 OR page_id % 7 = 0 THEN 'failed' ELSE 'enriched' END AS status FROM pages)"

ORACLES: dict[str, str] = {
    "filtered_accounts": f"WITH {SIGNALS} SELECT event_id, creator, value FROM signals WHERE platform = 'instagram' AND creator BETWEEN 0 AND 39 AND coalesce(value, 0) >= 12.35",
    "pending_or_forced": "SELECT c_custkey, 'plain' AS run FROM customer WHERE NOT EXISTS (FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') UNION ALL SELECT c_custkey, 'forced' FROM customer",
    "photo_fallback": f"""WITH p AS (SELECT DISTINCT user_id, 'p' || user_id AS image FROM events WHERE user_id % 2 = 0)
      SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'img' || {K} ELSE image END AS photo FROM events LEFT JOIN p USING (user_id)""",
    "matches_page": f"WITH {MATCHES} SELECT match_id, creator_id, score, c_name, c_mktsegment FROM m JOIN customer ON c_custkey = creator_id WHERE brand_id = 3 ORDER BY score DESC, creator_id LIMIT 12",
    "dashboard_join": f"WITH {MATCHES} SELECT status, score, n_name AS brand_name, c_name AS creator_name, creator_id FROM m JOIN nation ON n_nationkey = brand_id JOIN customer ON c_custkey = creator_id WHERE brand_id = 7 ORDER BY score DESC, creator_id LIMIT 12",
    "linked_count": "SELECT count(*) AS linked FROM events JOIN customer ON user_id = c_custkey",
    "brands_to_match": """WITH m AS (SELECT c_nationkey AS b FROM customer WHERE c_acctbal > 9700)
      SELECT n_nationkey::BIGINT AS brand_id, 'match' AS what, 0::BIGINT AS n FROM nation WHERE n_nationkey % 5 = 0 OR NOT EXISTS (FROM m WHERE b = n_nationkey)
      UNION ALL SELECT b::BIGINT, 'kept', count(*) FROM m WHERE b % 5 <> 0 GROUP BY b""",
    "reason_shapes": f"""WITH s AS (SELECT event_id, {pick('event_id', [f"'[\"a\",\"b' || {K} || '\"]'", f"'{{\"reasons\":[\"x\",\"y\"],\"breakdown\":{{\"n\":' || {K} || '}}}}'", "'not json'", "'{\"other\":1}'", 'NULL'])} AS x FROM events),
      j AS (SELECT event_id, TRY_CAST(x AS JSON) AS j FROM s)
      SELECT event_id, {pipe("CASE json_type(j) WHEN 'ARRAY' THEN j::VARCHAR[] WHEN 'OBJECT' THEN (j -> 'reasons')::VARCHAR[] END")} AS reasons, json_extract_string(j, '$.breakdown.n') AS n FROM j""",
    "match_breakdown": f"""{PAIRS} SELECT brand_id, creator_id, {rnd('n_s', 4)} AS niche_score, {rnd('t_s', 4)} AS topic_score, {rnd('p_s', 4)} AS platform_score, {rnd('e_s', 4)} AS engagement_score, platforms[1] AS best_platform, {rnd('boost', 4)} AS priority_boost FROM scored""",
    "match_spec": f"""WITH {SOLD}, {BRANDS} SELECT brand_id, {pipe(uniq('list_concat(match_topics, [goal])'))} AS topics, {pipe(uniq("list_filter([lower(n_name), coalesce(category, '')], lambda t: t <> '')"))} AS audiences,
        {pipe(uniq("list_filter(list_concat([category], match_topics[1:1]), lambda t: t IS NOT NULL)"))} AS priorities, {rnd(clamp("0.35 + 0.1 * ((len(match_topics) > 0)::INT + 3 + (category IS NOT NULL)::INT)"))} AS evidence_confidence,
        CASE WHEN len(match_topics) + 3 <= 1 THEN 0.2 WHEN len(match_topics) + 3 <= 4 THEN 0.5 WHEN len(match_topics) + 3 <= 8 THEN 0.68 ELSE 0.82 END::DOUBLE AS specificity FROM brands JOIN nation ON n_nationkey = brand_id""",
    "explorer_search": "SELECT p_partkey, 'ai tools' AS niche FROM part WHERE p_partkey % 8 = 1 AND p_partkey % 3 < 2 AND contains(lower(p_name || ' ' || p_type || ' ' || p_brand), 'small')",
    "explorer_page": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 12 OFFSET 24",
    "explorer_pages_by_range": """SELECT c_custkey, c_acctbal, ((r - 1) // 12 + 1)::BIGINT AS page FROM (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE (r - 1) // 12 IN (2, 99)""",
    "published_move": """SELECT 'source' AS side, c_custkey AS id, c_acctbal AS balance, NULL::VARCHAR AS origin FROM customer WHERE NOT coalesce(c_acctbal < 0, FALSE)
      UNION ALL SELECT 'target', c_custkey, c_acctbal, CASE WHEN c_custkey % 4 = 0 THEN 'old' ELSE 'migrated_from_creators' END FROM customer WHERE c_custkey % 4 = 0 OR c_acctbal < 0""",
    "filtered_by_many_ids": f"WITH {SIGNALS} SELECT event_id, creator, value FROM signals WHERE platform = 'youtube' AND event_id < 900 AND event_id % 2 = 0",
    "exists_either": "SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') OR EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'purchase')",
    "store_enrich_results": f"WITH {STORES} SELECT identity_id, slug, status, CASE status WHEN 'skipped' THEN 'identity missing canonical_stan_slug' WHEN 'failed' THEN CASE WHEN k % 11 = 0 THEN 'unknown error' ELSE 'HTTP 404' END END AS reason FROM stores",
    "store_enrich_stats": f"WITH {STORES} SELECT count(*) AS selected, count(*) AS processed, count(*) FILTER (status = 'enriched') AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped_no_slug FROM stores",
    "budget_ranked": "SELECT p_partkey, p_size AS score, p_retailprice FROM part WHERE p_retailprice <= 950.0::DOUBLE * 1.1::DOUBLE ORDER BY score DESC, p_partkey LIMIT 60",
    "deck_selection": f"""WITH r AS (SELECT n_nationkey, {pick('n_nationkey', ["'budget'", "'best'", "'why'", 'NULL', "'budget'"])} AS kind, {pick('n_nationkey', ['1000.0', 'NULL', '-2000.0'])}::DOUBLE AS b FROM nation),
      x AS (SELECT n_nationkey, kind, c_custkey, c_acctbal AS price, coalesce(b > 0 AND c_acctbal <= b * 1.1::DOUBLE, FALSE) AS fits FROM r JOIN customer ON c_nationkey = n_nationkey WHERE kind IS NOT NULL),
      y AS (SELECT *, bool_or(fits) OVER (PARTITION BY n_nationkey) AS within FROM x),
      z AS (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY price DESC, c_custkey) AS rank FROM y WHERE fits OR NOT within)
      SELECT n_nationkey, c_custkey, rank FROM z WHERE rank <= CASE WHEN kind = 'why' OR (kind = 'budget' AND NOT within) THEN 3 ELSE 6 END""",
    "deck_history": """WITH l AS (SELECT user_id, (floor(value)::BIGINT % 20) AS deck, max(event_id) AS at FROM events GROUP BY ALL)
      SELECT user_id, deck, "at", row_number() OVER (PARTITION BY user_id ORDER BY "at" DESC, deck) AS place FROM l QUALIFY place <= 7""",
    "two_key_order": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey LIMIT 300",
    "point_lookup": "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey = 17 OR c_name = 'Customer#000000023'",
    "table_writes": "SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END::DOUBLE AS c_acctbal, CASE WHEN c_acctbal < 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_nationkey < 20 AND (c_mktsegment <> 'BUILDING' OR c_acctbal < 0)",
    "seed_upsert": "SELECT s_suppkey::VARCHAR AS id, CASE WHEN s_acctbal < 5000 THEN 'new ' || s_name ELSE s_name END AS s_name, s_acctbal, 'creators' AS target FROM supplier WHERE s_acctbal > 0 OR s_acctbal < 5000",
    "seed_scan": "SELECT s_suppkey::VARCHAR AS id, CASE WHEN s_acctbal > 3000 THEN s_name ELSE 'b ' || s_name END AS name, 'pets' AS niche FROM supplier WHERE s_suppkey % 7 > 0",
    "query_groups": """WITH p AS (SELECT 'q' || page_id % 6 AS query, string_split(url, '/')[3] AS u, page_id FROM pages WHERE page_id % 6 > 0)
      SELECT query, count(*) AS n, count(DISTINCT u) AS n_urls, arg_min(u, page_id) AS first_url, min(page_id) AS place FROM p GROUP BY query""",
    "crawl_summary": "SELECT count(*) AS n, count(DISTINCT string_split(url, '/')[3]) AS n_urls, count(DISTINCT page_id % 5) AS n_agents, count(DISTINCT CASE WHEN page_id % 7 = 0 THEN (page_id % 5, page_id % 12) END) AS n_blocked FROM pages",
    "json_text_leaves": f"""SELECT event_id, array_to_string({uniq(f"list_concat(['t', event_type], CASE WHEN event_id % 5 > 0 THEN ['x \"q\"', '5', 'true', {K}] ELSE [] END)")}, '|') AS texts FROM events""",
    "site_challenge": "WITH p AS (SELECT page_id, page_id % 4 AS k FROM pages) SELECT page_id, k IN (0, 3) AS site, k IN (0, 2, 3) AS route FROM p",
    "quick_replies": f"""SELECT conv_id, turn, {pick('conv_id', ['NULL', "'first ' || conv_id || '|second|third|fourth'", 'NULL', "'first ' || conv_id || '|two'"])} AS options FROM conversations""",
    "shown_labels": f"""WITH p AS (SELECT p_partkey, p_partkey * p_partkey * 3 AS n, p_size, {pick('p_partkey', ["'synthetic'", "'stan pipeline'", "'hand made'", "'unknown'", "'unknown'"])} AS source FROM part)
      SELECT p_partkey, CASE WHEN n >= 1000000 THEN printf('%.1fM', n / 1e6) WHEN n >= 1000 THEN printf('%.1fK', n / 1e3) ELSE n::VARCHAR END AS count,
        CASE WHEN n <= 0 THEN '~1k' WHEN n >= 1000000 THEN floor(n / 1e6)::BIGINT || 'M+' WHEN n >= 10000 THEN floor(n / 1e3)::BIGINT || 'k+' WHEN n >= 1000 THEN '~' || floor(n / 1e3 + 0.5)::BIGINT || 'k' ELSE '~1k' END AS band,
        CASE WHEN p_size > 5 THEN printf('%.1f%%', p_size / 1000.0 * 100) ELSE '—' END AS share, source FROM p""",
    "intake_texts": f"""WITH r AS (SELECT n_nationkey, {pick('n_nationkey', [f"[{', '.join(map(q, v))}]" for v in rules.PARTNERSHIPS.values()])} AS p, {pick('n_nationkey', [*[f"[{', '.join(map(q, v))}]" for v in rules.COMPENSATIONS.values()], 'NULL'])} AS c, n_nationkey % 3 = 0 AS paid, CASE WHEN n_nationkey % 2 = 0 THEN 'per 1k views' ELSE 'per video' END AS per FROM nation)
      SELECT n_nationkey, array_to_string(list_filter([p[2], c[2], 'reach'], lambda x: x IS NOT NULL), '|') AS goal_signals, array_to_string(list_filter([p[3], c[3], CASE WHEN paid THEN 'creator rate $20 ' || per END], lambda x: x IS NOT NULL), '|') AS topic_signals,
        (1 + (c IS NOT NULL)::INT + 1 + 2 + paid::INT)::BIGINT AS angles FROM r""",
    "analysis_sources": """WITH p AS (SELECT page_id, page_id % 11 = 0 AS pages, page_id % 7 = 0 AS fetched, page_id % 2 = 0 AS searched, page_id % 3 = 0 AS site, page_id % 5 = 0 AS web, page_id % 4 = 0 AS c FROM pages),
      s AS (SELECT page_id, CASE WHEN pages THEN 'pages' WHEN fetched THEN 'fetched' WHEN c AND searched THEN 'searched' WHEN site THEN 'site' WHEN searched THEN 'searched' WHEN web THEN 'web' ELSE 'model' END AS source FROM p)
      SELECT page_id, source, CASE source WHEN 'pages' THEN '11 ' WHEN 'fetched' THEN '7 ' WHEN 'searched' THEN '2 ' WHEN 'site' THEN '3 ' WHEN 'web' THEN '5 ' END || page_id AS context FROM s""",
    "brand_searches": f"""WITH s AS (SELECT s_suppkey, 's' || s_suppkey || '.example.com' AS host, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS name FROM supplier),
      l AS (SELECT s_suppkey, 'site' AS kind, list_concat(CASE WHEN name IS NULL THEN [] ELSE ['site:' || host || ' "' || name || '"'] END, [{', '.join(f"'site:' || host || ' ' || {q(w)}" for _, w in rules.SITE_SEARCHES)}]) AS x FROM s
        UNION ALL SELECT s_suppkey, 'web', [{', '.join(f"coalesce(name, host) || ' ' || {q(w)}" for w in rules.WEB_SEARCHES)}] FROM s)
      SELECT s_suppkey, kind, (i - 1)::INT AS place, x[i] AS query FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM l)""",
    "url_inputs": f"""WITH p AS (SELECT page_id, page_id % 8 AS k, url, regexp_extract(url, '^[^#]*') AS bare FROM pages)
      SELECT page_id, {pick('k', ["'https://shop' || page_id || '.example.com/a'", "'https://localhost'", 'NULL', 'bare', "'HTTPS://www.YouTube.com/channel/UC-' || page_id", "'https://www.linkedin.com/in/Jo.' || page_id || '!/x'", "'https://www.tiktok.com/@TT_t'", "'https://x.com'"])} AS whole,
        'https://www.google.com/s2/favicons?domain=' || {pick('k', ["'shop' || page_id || '.example.com'", "'localhost'", 'NULL', f"lower({part('url', 2)})", "'www.youtube.com'", "'www.linkedin.com'", "'www.tiktok.com'", "'x.com'"])} || '&sz=128' AS icon,
        {pick('k', ['NULL', 'NULL', 'NULL', f"lower(regexp_replace(list_filter(string_split({part('url', 3)}, '/'), lambda x: x <> '')[1], '[^a-zA-Z0-9._-]', '', 'g'))", "'uc-' || page_id", "'jo.' || page_id", "'tt_t'", 'NULL'])} AS handle,
        {pick('k', ['NULL', 'NULL', 'NULL', 'NULL', "'youtube'", "'linkedin'", "'tiktok'", "'x'"])} AS platform FROM p""",
    "text_helpers": f"""WITH c AS (SELECT conv_id, turn, replace(replace('  a b ' || chr(9) || chr(10) || chr(10) || chr(10) || chr(10) || 'c' || coalesce(text, '') || chr(13) || ' ', chr(160), ' '), chr(13), '') AS t FROM conversations)
      SELECT conv_id, turn, md5(substring(regexp_replace(regexp_replace(regexp_replace(t, '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g'), 1, 450)) AS clean_md5, CASE WHEN conv_id % 3 = 0 THEN conv_id::VARCHAR END AS n FROM c""",
}

# Discovery and extraction.
KINDS = list(rules.PROFILE_LINKS)
PROFILES = {
    2: {"instagram": "https://instagram.com/jo.b", "x": "https://twitter.com/jo_t", "youtube": "https://youtube.com/channel/UC1"}, 3: {"linkedin": "https://linkedin.com/company/Co-1"}, 4: {"tiktok": "https://tiktok.com/@tt.t"},
}
HANDLES = {
    1: {"x": "jo_1", "instagram": "jo_1", "tiktok": "jo_1", "youtube": "jo_1"}, 2: {"x": "jo", "instagram": "jo.b", "tiktok": "jo.b", "youtube": "jo.b"}, 3: {"linkedin": "al-b"},
    4: {"x": "tt", "instagram": "ig_h", "tiktok": "tt.t", "youtube": "tt.t"},
}
CONFIDENCE = "0.1::DOUBLE + CASE WHEN slug IS NOT NULL THEN 0.38::DOUBLE ELSE 0 END + CASE WHEN followers > 0 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN url2 IS NOT NULL THEN 0.16::DOUBLE ELSE 0 END + CASE WHEN h2 IS NOT NULL THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN ig_url IS NOT NULL THEN 0.04::DOUBLE ELSE 0 END + CASE WHEN ig IS NOT NULL THEN 0.02::DOUBLE ELSE 0 END"
HANDLE_OF = f"""named AS (SELECT *, CASE WHEN profile IS NULL THEN NULL WHEN platform = 'linkedin' THEN s[2] WHEN platform = 'youtube' AND s[1] IN ('channel', 'c', 'user') THEN s[2] ELSE regexp_replace(s[1], '^@', '') END AS handle
    FROM (SELECT *, list_filter(string_split({part('profile', 3)}, '/'), lambda x: x <> '') AS s FROM profiles))"""
#: Which of the made URLs fits a plan's platform and path.
FITS = {"x": 0, "instagram": 1, "linkedin": 2, "tiktok": 4, "youtube": 5}
SIZED = lambda x: f"length({x}) || ':' || {x}"

ORACLES |= {
    "serp_ingest": f"""WITH {SPLIT}, {HANDLE_OF}, r AS (SELECT *, 'q' || page_id % 7 AS query, row_number() OVER (PARTITION BY page_id % 7 ORDER BY page_id) AS i FROM named)
      SELECT 'ra_' || sha256('1:r' || {SIZED('query')} || {SIZED('url')}) AS id, query, url, CASE WHEN page_id % 2 = 0 THEN page_id + 100 ELSE i END::INT AS position, platform, profile AS profile_url, handle FROM r WHERE page_id % 4 = 0 OR page_id % 9 <> 1
      QUALIFY row_number() OVER (PARTITION BY query, url ORDER BY position) = 1""",
    "plan_acceptance": f"""WITH p AS (SELECT page_id, page_id % 5 AS a, (page_id // 5) % 7 AS f FROM pages), k AS (SELECT page_id, {pick('a', [q(x[0]) for x in rules.PLANS])} AS agent, 'q' || page_id % 3 AS query FROM p WHERE page_id % 4 <> 0 AND f = {pick('a', [str(FITS[x[1]]) for x in rules.PLANS])}),
      r AS (SELECT *, row_number() OVER (PARTITION BY agent, query ORDER BY page_id) AS rank FROM k) SELECT page_id, agent, query, rank FROM r WHERE rank <= 10 QUALIFY row_number() OVER (PARTITION BY agent ORDER BY query, rank) <= 20""",
    "text_store_links": f"""SELECT page_id, {pick('page_id', ["'Some.Page'", "''", "''", "''", "'two|three'", "''"])} AS slugs, {pick('page_id', ['12500', '2000000', 'NULL', 'NULL', 'NULL', 'NULL'])}::BIGINT AS followers, {pick('page_id', ['3', '1', '0', '0', '0', '0'])}::BIGINT AS mentions FROM pages""",
    "text_profiles": f"""WITH k AS (SELECT page_id, page_id % 6 AS c, unnest([{', '.join(map(q, KINDS))}]) AS kind FROM pages), t(c, kind, profile, handle) AS (VALUES {', '.join(f"({c}, {q(k)}, {q(PROFILES.get(c, {}).get(k)) if PROFILES.get(c, {}).get(k) else 'NULL'}, {q(HANDLES.get(c, {}).get(k)) if HANDLES.get(c, {}).get(k) else 'NULL'})" for c in range(6) for k in KINDS)})
      SELECT page_id, kind, profile, handle FROM k JOIN t USING (c, kind)""",
    "extraction_assembly": f"""WITH {SPLIT}, {HANDLE_OF}, e AS (SELECT page_id, CASE WHEN platform = 'unknown' THEN 'x' ELSE platform END AS kind, CASE WHEN platform <> 'unknown' THEN profile END AS own, CASE WHEN platform <> 'unknown' THEN handle END AS h, page_id % 2 = 0 AS said FROM named),
      f AS (SELECT *, CASE WHEN said THEN 's' || page_id END AS slug, CASE WHEN said THEN 12500 END AS followers, coalesce(h, CASE WHEN said AND kind <> 'linkedin' THEN 'jo_1' END) AS h1 FROM e),
      g AS (SELECT *, coalesce(own, CASE WHEN h1 IS NOT NULL THEN CASE kind WHEN 'x' THEN 'https://x.com/' WHEN 'instagram' THEN 'https://instagram.com/' WHEN 'linkedin' THEN 'https://linkedin.com/in/' WHEN 'tiktok' THEN 'https://tiktok.com/@' ELSE 'https://youtube.com/@' END || h1 END) AS u1 FROM f),
      h AS (SELECT *, CASE WHEN kind = 'youtube' AND said AND contains(u1, '/channel/') THEN 'jo_1' ELSE h1 END AS h2, CASE WHEN kind = 'youtube' AND said AND contains(u1, '/channel/') THEN 'https://youtube.com/@jo_1' ELSE u1 END AS url2 FROM g),
      i AS (SELECT *, CASE WHEN kind = 'instagram' THEN url2 END AS ig_url, CASE WHEN kind = 'instagram' THEN coalesce(h2, CASE WHEN said THEN 'jo_1' END) WHEN said THEN 'jo_1' END AS ig FROM h)
      SELECT page_id, kind, slug AS store_slug, followers::BIGINT AS followers, url2 AS profile_url, h2 AS handle, ig AS instagram_handle,
        array_to_string(list_filter([CASE WHEN slug IS NOT NULL THEN 'store_slug' END, CASE WHEN followers > 0 THEN 'followers' END, CASE WHEN url2 IS NOT NULL THEN kind || '_profile_url' END, CASE WHEN h2 IS NOT NULL THEN kind || '_handle' END, CASE WHEN ig_url IS NOT NULL THEN 'instagram_profile_url' END, CASE WHEN ig IS NOT NULL THEN 'instagram_handle' END], lambda x: x IS NOT NULL), '|') AS signals,
        {rnd(clamp(CONFIDENCE), 3)} AS confidence FROM i""",
    "handles_from_mentions": f"""SELECT page_id, {pick('page_id', ["'jo_' || page_id", 'NULL', 'NULL', "'chan'", 'NULL'])} AS x, {pick('page_id', ["'jo_' || page_id", "'ig.' || page_id", 'NULL', "'chan'", 'NULL'])} AS instagram, {pick('page_id', ['NULL', 'NULL', "'Co-1'", 'NULL', 'NULL'])} AS linkedin,
        {pick('page_id', ["'jo_' || page_id", 'NULL', 'NULL', "'chan'", 'NULL'])} AS tiktok, {pick('page_id', ["'jo_' || page_id", 'NULL', 'NULL', "'chan-1'", 'NULL'])} AS youtube,
        {pick('page_id', ["'ok_1'", 'NULL', 'NULL', 'NULL', 'NULL'])} AS clean_x, {pick('page_id', ["'ok_1'", 'NULL', "'way_too_long_for_a_handle_of_x'", 'NULL', "'a.b-c'"])} AS clean_youtube, {pick('page_id', ["'ok_1'", "'a b'", "'way_too_long_for_a_handle_of_x'", 'NULL', "'a.b-c'"])} AS clean_unknown FROM pages""",
    "crawl_pages": """WITH d AS (SELECT source AS brand_id, 'https://' || source || '/' || doc_id AS url, CASE WHEN doc_id % 2 = 1 THEN lang END AS title, coalesce(text, '') AS text, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
      c AS (SELECT brand_id, url, title, doc_id, substring(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(160), ' '), chr(13), ''), '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g'), 1, 35000) AS t FROM d WHERE r <= 6 AND doc_id % 5 <> 0)
      SELECT brand_id, url, title, length(t) AS n, md5(t) AS text_md5 FROM c WHERE length(t) >= 400
      UNION ALL SELECT source, 'https://' || source || '/' || doc_id, CASE WHEN doc_id % 2 = 1 THEN lang ELSE '' END, 4, md5('kept') FROM documents WHERE doc_id % 5 = 0""",
    "store_pages": f"""WITH p AS (SELECT page_id AS k, page_id % 2 = 0 AS sells FROM pages)
      SELECT k AS page_id, 'Jo ' || k AS profile_name, 'jo' || k AS handle, CASE WHEN k % 3 = 0 THEN 'About me' END AS bio, 'https://instagram.com/jo|https://jo.example.com/a' AS outbound, 'https://instagram.com/jo' AS socials, CASE WHEN k % 5 = 0 THEN 'a@b.co' ELSE '' END AS emails,
        CASE WHEN sells THEN '$1,200.50|$9' ELSE '' END AS prices, CASE WHEN sells THEN 'course|coaching|membership|digital_guide' ELSE '' END AS types, CASE WHEN sells THEN 'consultative' ELSE 'generic' END AS cta, CASE WHEN k % 4 = 0 THEN 'i.png' END AS image, CASE WHEN sells THEN 3 ELSE 0 END::BIGINT AS offers,
        {clamp(rnd("0.25::DOUBLE + 0.08::DOUBLE + CASE WHEN k % 3 = 0 THEN 0.12::DOUBLE ELSE 0 END + CASE WHEN sells THEN 0.16::DOUBLE ELSE 0 END + CASE WHEN sells THEN 0.14::DOUBLE ELSE 0 END + CASE WHEN sells THEN 0.13::DOUBLE ELSE 0 END + 0.1::DOUBLE + CASE WHEN k % 4 = 0 THEN 0.07::DOUBLE ELSE 0 END + CASE WHEN k % 5 = 0 THEN 0.07::DOUBLE ELSE 0 END + CASE WHEN sells THEN 0.04::DOUBLE ELSE 0 END + CASE WHEN sells THEN 0.04::DOUBLE ELSE 0 END", 3))}::DOUBLE AS confidence FROM p""",
}
BARE = "regexp_extract(url, '^[^?#]*') || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END".replace("{kept}", "list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda kv: kv <> '' AND NOT regexp_full_match(lower(regexp_extract(kv, '^[^=]*')), 'utm_|fbclid|gclid|si'))")
ORACLES["ordered_merge"] = f"""WITH u AS (SELECT page_id, {BARE} AS url FROM pages), r AS (SELECT url, 0 AS list, page_id FROM u WHERE page_id % 3 = 0 UNION ALL SELECT CASE WHEN page_id % 4 = 0 THEN 'https://same.example.com/' ELSE url END, 1, page_id FROM u)
  SELECT url, list, page_id FROM r QUALIFY row_number() OVER (PARTITION BY url ORDER BY list, page_id) = 1"""

# Identities, enrichment, import.
ACCOUNTS = f"""a AS (SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN list_filter(string_split({part('url', 3)}, '/'), lambda x: x <> '')[2] END AS slug, CASE WHEN page_id % 5 <> 0 THEN regexp_replace(lower({part('url', 2)}), '^www\\.', '') END AS domain FROM pages)"""
SOCIAL = f"""{SIGNALS}, acc AS (SELECT creator AS id, platform, max(followers)::DOUBLE AS f, count(*) AS n FROM signals GROUP BY ALL),
ob AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'instagram' WHEN 2 THEN 'youtube' END AS platform FROM customer WHERE c_custkey % 2 = 0),
cand AS (SELECT coalesce(acc.id, ob.id) AS id, coalesce(acc.platform, ob.platform) AS platform, f, coalesce(n, 0) AS n, ob.id IS NOT NULL AS o FROM acc FULL JOIN ob ON acc.id = ob.id AND acc.platform = ob.platform)"""
RESULTS = f"""{SOCIAL}, cnt AS (SELECT id, count(*) AS n, count(*) FILTER (coalesce(f > 0 AND f < 30000, FALSE)) AS low, count(*) FILTER (NOT coalesce(f > 0 AND f < 30000, FALSE) AND (n > 0 OR o)) AS usable FROM cand GROUP BY id),
res AS (SELECT c_custkey AS identity_id, CASE WHEN cnt.n IS NULL THEN 'no social account signals found' WHEN usable = 0 THEN CASE WHEN low > 0 THEN 'all signals filtered by minFollowerEstimate' ELSE 'insufficient social signals after filtering' END END AS reason, coalesce(usable, 0) AS platforms, c_custkey % 3 = 0 AS h FROM customer LEFT JOIN cnt ON id = c_custkey),
final AS (SELECT identity_id, CASE WHEN reason IS NOT NULL THEN 'skipped' WHEN h THEN 'updated' ELSE 'enriched' END AS status, reason, platforms FROM res)"""
RATE = clamp(f"{prior(rules.ENGAGEMENT)} + least(0.02::DOUBLE, greatest(0, n - 1) * 0.003::DOUBLE) + CASE WHEN o THEN 0.002::DOUBLE ELSE 0 END", "0.008", "0.2")
SURE = clamp(rnd("0.24::DOUBLE + CASE WHEN platform <> 'unknown' THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN has THEN 0.34::DOUBLE ELSE 0 END + CASE WHEN n >= 2 THEN 0.14::DOUBLE ELSE 0 END + CASE WHEN n >= 4 THEN 0.06::DOUBLE ELSE 0 END + CASE WHEN o THEN 0.12::DOUBLE ELSE 0 END + CASE WHEN has THEN 0.1::DOUBLE ELSE 0 END", 3), "0.2", "0.95")
IMPORT = f"""{CREATORS}, talk AS (SELECT *, creator_id AS k, [{', '.join(map(q, WORDS))}][creator_id % 8 + 1] AS text FROM creators), low AS (SELECT *, lower(text) AS t FROM talk), {NICHES},
scores AS (SELECT creator_id AS cid, m.platform AS p, {rnd('log10(greatest(1.0, m.avg_views + 1)) * 0.5 + log10(greatest(1.0, m.followers + 1)) * 0.35 + m.confidence * 0.15', 9)} AS s FROM (SELECT creator_id, unnest(metrics) AS m FROM creators)),
prim AS (SELECT cid, p AS best FROM scores WHERE p <> 'unknown' QUALIFY row_number() OVER (PARTITION BY cid ORDER BY s DESC, p) = 1),
ready AS (SELECT s.*, best, len(metrics) > 0 AS social, {rnd(clamp('0.35 + top * 1.3', '0.25', '0.98'), 3)} AS n_conf, len({uniq(ALL_TOPICS)}[1:12]) AS n_topics, len({uniq(ALL_AUDIENCES)}[1:8]) AS n_aud FROM styled s LEFT JOIN prim ON cid = k)"""

ORACLES |= {
    "enrich_results": f"WITH {RESULTS} SELECT identity_id, status, reason, platforms FROM final",
    "enrich_stats": f"""WITH {RESULTS} SELECT count(*) AS selected, count(*) AS processed, count(*) FILTER (status = 'enriched') AS enriched, count(*) FILTER (status = 'updated') AS updated, count(*) FILTER (reason LIKE 'no social%') AS skipped_no_signals,
      count(*) FILTER (status = 'skipped' AND reason NOT LIKE 'no social%') AS skipped_low_followers, 0::BIGINT AS failed FROM final""",
    "metric_sync": f"""WITH {SOCIAL}, s AS (SELECT *, coalesce(f > 0, FALSE) AS has FROM cand), v AS (SELECT id, platform, CASE WHEN has THEN floor(f + 0.5) END AS f, {rnd(RATE, 4)} AS rate, {SURE}::DOUBLE AS c FROM s),
      g AS (SELECT id, count(*) AS n_signals, {rnd('avg(c)', 4)} AS avg_confidence, {rnd('sum(rate * greatest(0.2, c) * CASE WHEN f IS NULL THEN 1.0 ELSE log10(f + 10) END) / sum(greatest(0.2, c) * CASE WHEN f IS NULL THEN 1.0 ELSE log10(f + 10) END)', 4)} AS engagement, list_sort(list(platform) FILTER (platform <> 'unknown')) AS ps, list(concat_ws(':', platform, f::BIGINT)) FILTER (platform <> 'unknown') AS ms FROM v GROUP BY id)
      SELECT id AS identity_id, {pipe(uniq("list_concat(['x', 'youtube'], coalesce(ps, []))"))} AS platforms,
        array_to_string(list_sort(list_concat(coalesce(ms, []), CASE WHEN id % 2 = 0 THEN list_concat(['x:7'], CASE WHEN list_contains(coalesce(ps, []), 'instagram') THEN [] ELSE ['instagram:9'] END) ELSE [] END)), '|') AS measured,
        engagement, avg_confidence, n_signals FROM g JOIN customer ON c_custkey = id""",
    "metric_sanitation": f"""WITH {MEASURED} SELECT creator, platform, CASE WHEN n % 2 = 0 THEN 0.0 ELSE floor(followers + 0.5 + 0.5) END::DOUBLE AS followers, {rnd(clamp('engagement_rate * 20'))} AS engagement_rate, {rnd('confidence')} AS confidence, NULL::DOUBLE AS sample_size
      FROM (SELECT *, sample_size::BIGINT AS n FROM measured) WHERE platform <> 'unknown'""",
    "identity_run": f"""WITH RECURSIVE {FOLD}, l AS (SELECT 'h' || user_id % 7 AS handle, CASE event_id % 2 WHEN 0 THEN 'x' ELSE 'youtube' END AS platform, 'ci_' || event_id AS i, ts FROM events),
      r AS (SELECT *, CASE WHEN page_id <= 100 THEN 'first' ELSE 'second' END AS run, 'ci_' || sha256(length(anchor) || ':' || anchor) AS identity_id, 'h' || page_id % 9 AS handle, CASE page_id % 2 WHEN 0 THEN 'x' ELSE 'tiktok' END AS platform,
        CASE WHEN slug IS NOT NULL THEN CASE WHEN page_id % 4 = 1 THEN 'merged_by_cross_link' ELSE 'merged_by_slug' END WHEN domain IS NOT NULL THEN CASE WHEN page_id % 4 = 2 THEN 'merged_by_cross_link' ELSE 'merged_by_domain' END ELSE 'queued' END AS counted FROM f WHERE i > 0),
      c AS (SELECT page_id, arg_max(l.i, (ts, l.i)) AS candidate FROM r JOIN l ON r.handle = l.handle AND r.platform <> l.platform WHERE anchor IS NULL GROUP BY page_id),
      born AS (SELECT anchor, arg_min(run, page_id) AS run FROM r WHERE anchor IS NOT NULL GROUP BY anchor),
      names AS (SELECT run, account FROM (SELECT unnest(['first', 'second']) AS run), (SELECT unnest(['processed', 'merged_by_slug', 'merged_by_domain', 'merged_by_cross_link', 'queued', 'created']) AS account)),
      counts AS (SELECT run, counted AS account, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT run, 'processed', count(*) FROM r GROUP BY run UNION ALL SELECT run, 'created', count(*) FROM born GROUP BY run)
      SELECT run, page_id::VARCHAR AS account, coalesce(identity_id, candidate) AS found, CASE WHEN anchor IS NOT NULL THEN 1.0 WHEN candidate IS NULL THEN 0.3 ELSE 0.55 END::DOUBLE AS confidence, NULL::BIGINT AS n FROM r LEFT JOIN c USING (page_id)
      UNION ALL SELECT run, account, NULL, NULL, coalesce(n, 0) FROM names LEFT JOIN counts USING (run, account)""",
    "import_assembly": f"""WITH {IMPORT} SELECT 'cr_real_' || lpad(k::VARCHAR, 12, '0') AS creator_id, CASE WHEN k % 5 = 0 THEN 'skipped' WHEN k % 7 = 0 THEN 'updated' ELSE 'imported' END AS status, CASE WHEN k % 5 = 0 THEN 'missing stan profile' END AS reason,
        CASE WHEN k % 3 = 0 THEN 'Jo B' || k WHEN k % 4 = 0 THEN 'Store ' || k ELSE 'Creator ' || lpad(k::VARCHAR, 12, '0')[1:8] END AS name,
        CASE WHEN k % 5 <> 0 THEN 'https://stan.store/' || k || '|' ELSE '' END || 'https://x.com/u' || k || '|https://a.com/' || k AS links, [{', '.join(q(r[0]) for r in rules.NICHES)}][i] AS niche,
        {rnd(clamp("0.3::DOUBLE + CASE WHEN k % 2 = 0 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN len(p1) >= 1 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN len(p1) >= 3 THEN 0.06::DOUBLE ELSE 0 END + CASE WHEN list_contains(i1, 'direct_purchase') THEN 0.14::DOUBLE ELSE 0 END + CASE WHEN list_contains(i1, 'lead_generation') THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN list_contains(i1, 'affiliate') THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN style IN ('direct_response', 'consultative') THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN social THEN 0.07::DOUBLE ELSE 0 END + CASE WHEN best IS NOT NULL THEN 0.04::DOUBLE ELSE 0 END", '0.1', '0.98'), 3)}::DOUBLE AS buying_intent, best AS primary_platform,
        {rnd(clamp("0.26::DOUBLE + 0.23::DOUBLE * 0.5::DOUBLE + 0.2::DOUBLE * ((k % 10) / 10.0::DOUBLE) + 0.12::DOUBLE * n_conf + 0.07::DOUBLE * least(1.0::DOUBLE, n_topics / 8.0::DOUBLE) + 0.05::DOUBLE * least(1.0::DOUBLE, n_aud / 5.0::DOUBLE) + 0.04::DOUBLE * least(1.0::DOUBLE, len(p1) / 4.0::DOUBLE) + CASE WHEN social THEN 0.08::DOUBLE ELSE 0 END", '0.2', '0.98'), 3)}::DOUBLE AS confidence FROM ready""",
    "import_stats": "SELECT count(*) AS selected, count(*) FILTER (c_custkey % 5 = 0) AS skipped_missing_profile, 0::BIGINT AS skipped_low_confidence, count(*) FILTER (c_custkey % 5 <> 0 AND c_custkey % 7 <> 0) AS imported, count(*) FILTER (c_custkey % 5 <> 0 AND c_custkey % 7 = 0) AS updated FROM customer",
    "chat_priorities": """WITH c AS (SELECT conv_id, turn, (conv_id + turn) % 5 AS k, regexp_matches(coalesce(text, ''), '(?i)influencers|creators|content about|topics around|focus on topics|covering') AS asks FROM conversations)
      SELECT conv_id, turn, CASE WHEN asks THEN 'its own' ELSE ['ai tools|pets ' || conv_id || '|looking for ai tools', 'best fitness|travel|yoga|want the best fitness', '', '', ''][k + 1] END AS niches,
        CASE WHEN asks THEN 'its own' ELSE ['ai tools|pets ' || conv_id || '|looking for ai tools', 'best fitness|travel|yoga|want the best fitness|money habits', '', 'home decor|item ' || turn, ''][k + 1] END AS topics FROM c""",
}
