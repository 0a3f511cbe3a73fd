"""DuckDB counterparts of the registered queries."""

from __future__ import annotations

from agorafold.functions.ids import GENESIS
from agorafold.operators.communities import FALLBACK_TOPICS
from agorafold.operators.notices import EVENT_TYPES, MESSAGES
from agorafold.operators import search, text_index
from agorafold.operators.search import K1, B, QUERY

_P = """p AS (
  SELECT o_orderkey AS id, o_custkey AS author, o_orderdate AS created, o_totalprice::DECIMAL(10,3) AS payout, o_orderstatus = 'F' AS paid,
    o_orderpriority AS category, c_nationkey AS community, c_acctbal < 0 AS grayed, o_orderkey % 50 = 7 AS deleted,
    CASE WHEN o_orderkey % 10 <> 0 THEN o_orderkey // 3 END AS parent
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey), l AS (SELECT * FROM p WHERE NOT deleted)"""
_V = """v AS (
  SELECT l_orderkey AS post, l_suppkey AS voter, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * round(l_extendedprice * 100)::BIGINT AS rshares,
    l_linestatus = 'F' AS effective, l_shipdate AS at_ FROM lineitem)"""
_R = """r AS (
  SELECT post, sum(rshares)::BIGINT AS rshares, sum(abs(rshares))::BIGINT AS abs_rshares, count(*) FILTER (effective) AS total_votes, sum(sign(rshares))::BIGINT AS net_votes
  FROM v GROUP BY post)"""
_LOG = "CASE WHEN coalesce(rshares, 0) > 0 THEN 1 ELSE -1 END * log10(greatest(abs(coalesce(rshares, 0) / 10000000.0), 1))"
_S = f"""s AS (
  SELECT l.*, ({_LOG} + epoch(created) / 240000.0)::FLOAT AS sc_trend, ({_LOG} + epoch(created) / 10000.0)::FLOAT AS sc_hot
  FROM l LEFT JOIN r ON l.id = r.post)"""
_G = "g AS (SELECT DISTINCT l_orderkey AS post, p_brand AS tag FROM lineitem JOIN part ON l_partkey = p_partkey)"
_F = "f AS (SELECT DISTINCT l_suppkey AS follower, o_custkey AS following FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'A')"
_M = "m AS (SELECT DISTINCT l_suppkey AS follower, o_custkey AS following FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_quantity >= 45)"
_FM = """fm AS (SELECT * FROM (SELECT DISTINCT s_suppkey AS follower, unnest([s_suppkey % 97 + 1, s_suppkey % 89 + 1]) AS following FROM supplier)
  WHERE follower <> following AND following IN (SELECT l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_quantity >= 45))"""
_FN = "fm AS (SELECT a.s_suppkey AS follower, b.s_suppkey AS following FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey WHERE b.s_suppkey IN (SELECT l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_quantity >= 45))"
_MB = """mb AS (
  SELECT following AS muted FROM m WHERE follower = 1
  UNION SELECT m.following FROM m JOIN fm ON fm.following = m.follower WHERE fm.follower = 1)"""
_SUB = "sub AS (SELECT DISTINCT c_nationkey AS community FROM customer JOIN f ON following = c_custkey WHERE follower = 1 AND c_nationkey % 2 = 1)"
_SCORED = ", ".join((_P, _V, _R, _S))


def _top(ctes: str, rows: str, score: str, shown: str | None = None) -> str:
    shown = shown or f"round({score}::DOUBLE, 3)"
    return f"WITH {ctes} SELECT id, author, category, {shown} AS score FROM {rows} ORDER BY {score} DESC NULLS LAST, id DESC LIMIT 20"


_RANK = """k AS (
  SELECT n_nationkey AS community, n_name AS title, coalesce(payouts, 0) AS payouts, coalesce(posts, 0) AS posts, coalesce(authors, 0) AS authors, coalesce(subscribers, 0) AS subscribers
  FROM nation
  LEFT JOIN (SELECT community, round(sum(payout), 0)::BIGINT AS payouts, count(*) AS posts, count(DISTINCT author) AS authors FROM l WHERE NOT paid AND community IS NOT NULL GROUP BY community) a ON a.community = n_nationkey
  LEFT JOIN (SELECT c_nationkey, count(*) AS subscribers FROM customer GROUP BY c_nationkey) b ON b.c_nationkey = n_nationkey
), k2 AS (SELECT *, row_number() OVER (ORDER BY payouts DESC, authors DESC, posts DESC, subscribers DESC, CASE WHEN title = '' THEN 1 ELSE 0 END, community DESC)::INT AS rank FROM k)"""
_KIND = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in EVENT_TYPES.items()) + " ELSE 0 END"
_TEMPLATE = "CASE kind " + " ".join(f"WHEN {k} THEN '{v[1]}'" for k, v in MESSAGES.items()) + " END"
_WALK = "walk(id, above) AS (SELECT id, parent FROM n WHERE parent IS NOT NULL UNION ALL SELECT w.id, n.parent FROM walk w JOIN n ON n.id = w.above WHERE n.parent IS NOT NULL)"


def _search(query: str, sort: str = "relevance", author: str | None = None, without: tuple[str, ...] = (), page: int = 1) -> str:
    """A page of a search, from the whole texts."""
    clauses, counts, conditions, parts, frequencies = search.parse(query), [], [], [], {}
    for i, c in enumerate(clauses):
        fields = search.searched(c)
        for f in fields:
            row = " AND ".join(f"{f}[i + {k}] = '{w}'" for k, w in enumerate(c.words))
            counts.append(f"len(list_filter(range(1, len({f}) - {len(c.words) - 2}), lambda i: {row})) AS n{i}_{f}")
            if c.sign != "-" and f in search.FIELDS:
                frequencies |= {f"d_{w}_{f}": f"count(*) FILTER (list_contains({f}, '{w}'))" for w in c.words}
                rare = " + ".join(f"ln(1 + (total - d_{w}_{f} + 0.5) / (d_{w}_{f} + 0.5))" for w in c.words)
                parts.append(f"CASE WHEN n{i}_{f} > 0 THEN ({rare}) * n{i}_{f} * {K1 + 1} / (n{i}_{f} + {K1} * (1 - {B} + {B} * length_{f} / average_{f})) ELSE 0 END")
        conditions.append(f"{'' if c.sign != '-' else 'NOT '}({' OR '.join(f'n{i}_{f} > 0' for f in fields)})")
    if author is not None:
        conditions.append(f"source = '{author}'")
    conditions += [f"source <> '{x}'" for x in without]
    words = lambda text, name: f"regexp_extract_all(lower({text}), '[a-z0-9]+') AS {name}"
    known = "".join(f", {v} AS {k}" for k, v in frequencies.items())
    return f"""WITH d AS (SELECT doc_id AS id, source, {words("split_part(coalesce(text, ''), chr(10), 1)", "title")}, {words("coalesce(text, '')", "body")}, {words("coalesce(lang, '')", "lang")} FROM documents),
      c AS (SELECT id, source, len(title) AS length_title, len(body) AS length_body, {", ".join(counts)} FROM d), t AS (SELECT count(*) AS total, avg(len(title)) AS average_title, avg(len(body)) AS average_body{known} FROM d)
      SELECT id, round({" + ".join(parts) or "0"}, 6) AS score FROM c, t WHERE {" AND ".join(conditions)} ORDER BY {"2 DESC, 1" if sort == "relevance" else "1"} DESC LIMIT 20 OFFSET {20 * page - 20}"""


def _day(at: str) -> str:
    return f"date_diff('day', DATE '1992-01-01', {at}::DATE)"


def _at(days: str) -> str:
    return f"(TIMESTAMP '1992-01-01' + to_days(({days})::INT))"


def _counts(terms: tuple[str, ...]) -> str:
    return ", ".join(f"len(list_filter(w, lambda x: x = '{t}'))::DOUBLE AS n{i}" for i, t in enumerate(terms))


def _frequencies(n: int) -> str:
    return ", ".join(f"count(*) FILTER (n{i} > 0) AS d{i}" for i in range(n))


def _bm25(n: int) -> str:
    return " + ".join(f"ln(1 + (total - d{i} + 0.5) / (d{i} + 0.5)) * n{i} * ({K1} + 1) / (n{i} + {K1} * (1 - {B} + {B} * length / average))" for i in range(n))


def _feed(page: str, when: str = "TRUE") -> str:
    return f"""WITH {_P}, {_F}, e AS (SELECT id, author AS by_, created AS at_ FROM l UNION ALL SELECT parent, author, created FROM l WHERE parent IS NOT NULL)
      SELECT id, min(at_) AS first_at, string_agg(DISTINCT c_name, ',' ORDER BY c_name) AS names FROM e JOIN customer ON by_ = c_custkey
      WHERE by_ IN (SELECT following FROM f WHERE follower = 3) AND {when} GROUP BY id ORDER BY 2 DESC, id DESC {page}"""


_RAW = "(round(c_acctbal * 100)::BIGINT * 10000000000)"

#: Of each order its rows and what it ranks by.
_SORTS = {
    "trending": ("s", "NOT paid AND parent IS NULL", "sc_trend"), "hot": ("s", "NOT paid AND parent IS NULL", "sc_hot"), "created": ("l", "NOT grayed AND parent IS NULL", "id"),
    "payout": ("l, (SELECT max(created) AS head FROM l)", "NOT paid AND created + INTERVAL 7 DAY BETWEEN head + INTERVAL 12 HOUR AND head + INTERVAL 36 HOUR", "payout"),
    "payout_comments": ("l", "NOT paid AND parent IS NOT NULL", "payout"), "muted": ("l", "NOT paid AND grayed AND payout > 0", "payout"),
}
_SCOPES = {"all": "TRUE", "tag": "id IN (SELECT post FROM g WHERE tag = 'Brand#13')", "community": "community = 7", "my": "community IN (SELECT community FROM sub)"}


def ranked_pair(sort: str, scope: str) -> str:
    rows, when, score = _SORTS[sort]
    if scope in ("community", "my"):  # root posts; created has no filter in one community
        when = {"payout": f"{when} AND parent IS NULL", "payout_comments": "NOT paid AND parent IS NULL", "muted": f"{when} AND parent IS NULL"}.get(sort, when)
        when = "parent IS NULL" if (sort, scope) == ("created", "community") else when
    if scope == "tag" and sort in ("payout", "payout_comments"):
        return _top(_P, f"{rows} WHERE {when} AND category = '1-URGENT'", score)
    return _top(f"{_SCORED}, {_G}, {_F}, {_SUB}", f"{rows} WHERE {when} AND {_SCOPES[scope]}", score)


SQL = {
    "ranked_trending_all": _top(_SCORED, "s WHERE NOT paid AND parent IS NULL", "sc_trend"),
    "ranked_hot_all": _top(_SCORED, "s WHERE NOT paid AND parent IS NULL", "sc_hot"),
    "ranked_created_all": _top(_P, "l WHERE NOT grayed AND parent IS NULL", "id"),
    "ranked_payout_window": _top(_P, "l, (SELECT max(created) AS head FROM l) WHERE NOT paid AND created + INTERVAL 7 DAY BETWEEN head + INTERVAL 12 HOUR AND head + INTERVAL 36 HOUR", "payout"),
    "ranked_payout_comments": _top(_P, "l WHERE NOT paid AND parent IS NOT NULL", "payout"),
    "ranked_muted": _top(_P, "l WHERE NOT paid AND grayed AND payout > 0", "payout"),
    "ranked_by_tag": _top(f"{_SCORED}, {_G}", "s WHERE NOT paid AND parent IS NULL AND id IN (SELECT post FROM g WHERE tag = 'Brand#13')", "sc_trend"),
    "ranked_by_community": _top(_SCORED, "s WHERE NOT paid AND parent IS NULL AND community = 7", "sc_trend"),
    "ranked_my_hot": _top(f"{_SCORED}, {_F}, {_SUB}", "s WHERE NOT paid AND parent IS NULL AND community IN (SELECT community FROM sub)", "sc_hot"),
    "ranked_my_lateral_topk": f"""WITH {_P}, {_F}, {_SUB}
      SELECT id, author, category, community FROM (
        SELECT *, row_number() OVER (PARTITION BY community ORDER BY id DESC) AS rn FROM l WHERE NOT grayed AND parent IS NULL AND community IN (SELECT community FROM sub))
      WHERE rn <= 5 ORDER BY id DESC LIMIT 20""",
    "ranked_pinned_two_tier": f"""WITH {_SCORED}, c AS (SELECT *, category = '1-URGENT' AND payout > 400000 AS pinned FROM s WHERE NOT paid AND parent IS NULL AND community = 7),
      t AS (SELECT * FROM (SELECT id, 0 AS tier, NULL::FLOAT AS sc FROM c WHERE pinned ORDER BY id DESC LIMIT 20)
        UNION ALL SELECT * FROM (SELECT id, 1 AS tier, sc_trend AS sc FROM c WHERE NOT pinned ORDER BY sc_trend DESC, id DESC LIMIT 20))
      SELECT id, tier, round(sc::DOUBLE, 3) AS score FROM t ORDER BY tier, sc DESC NULLS LAST, id DESC LIMIT 20""",
    "keyset_page_two": f"""WITH {_SCORED}, c AS (SELECT *, row_number() OVER (ORDER BY sc_trend DESC, id DESC) AS rn FROM s WHERE NOT paid AND parent IS NULL)
      SELECT id, author, category, round(sc_trend::DOUBLE, 3) AS score FROM c WHERE rn BETWEEN 21 AND 40""",
    "observer_mute_filter": _top(f"{_SCORED}, {_M}, {_FM}, {_MB}", "s WHERE NOT paid AND parent IS NULL AND author NOT IN (SELECT muted FROM mb)", "sc_trend"),
    "star_join_view": f"""WITH {_SCORED}, t AS (SELECT * FROM s WHERE NOT paid AND parent IS NULL ORDER BY sc_trend DESC, id DESC LIMIT 20)
      SELECT t.id, a.c_name AS author_name, n_name AS community_title, r_name AS region_name, t.category, t.payout, round(sc_trend::DOUBLE, 3) AS score, t.parent, b.c_name AS parent_author
      FROM t LEFT JOIN customer a ON a.c_custkey = t.author LEFT JOIN nation ON n_nationkey = a.c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
      LEFT JOIN p q ON q.id = t.parent LEFT JOIN customer b ON b.c_custkey = q.author""",
    "follow_counts": f"WITH {_F} SELECT following AS account, count(*) AS n, 'followers' AS side FROM f GROUP BY 1 UNION ALL SELECT follower, count(*), 'following' FROM f GROUP BY 1",
    "followers_page": f"WITH {_F} SELECT s_name AS name FROM supplier WHERE s_suppkey IN (SELECT follower FROM f WHERE following = 7) AND s_name > 'Supplier#000000001' ORDER BY 1 LIMIT 100",
    "blacklist_listagg": f"WITH {_M} SELECT following AS account, string_agg(s_name, ',' ORDER BY s_name) AS lists, count(*) AS n_lists FROM m JOIN supplier ON follower = s_suppkey GROUP BY 1",
    "relationship_flags": f"""WITH {_F}, {_M}, {_FN}, e AS (SELECT *, 'follows' AS kind FROM f UNION ALL SELECT *, 'ignores' FROM m UNION ALL SELECT *, 'follows_muted' FROM fm)
      SELECT follower, following, bool_or(kind = 'follows') AS follows, bool_or(kind = 'ignores') AS ignores, bool_or(kind = 'blacklists') AS blacklists,
        bool_or(kind = 'follows_blacklists') AS follows_blacklists, bool_or(kind = 'follows_muted') AS follows_muted FROM e GROUP BY 1, 2""",
    "observer_mutes": f"WITH {_M}, {_FN} SELECT follower AS observer, following AS muted FROM m UNION SELECT fm.follower, m.following FROM fm JOIN m ON fm.following = m.follower",
    "missing_accounts": f"WITH {_P} SELECT c_custkey AS account FROM customer EXCEPT SELECT author FROM l WHERE parent IS NULL",
    "account_posts": f"WITH {_P} SELECT id, created, category, payout FROM l WHERE author = 48 AND parent IS NULL ORDER BY id DESC LIMIT 20",
    "account_replies": f"WITH {_P} SELECT c.id, c.author, c.parent, c.created FROM l c JOIN l o ON c.parent = o.id WHERE o.author = 7 ORDER BY c.id DESC LIMIT 20",
    "account_payout": f"WITH {_P} SELECT id, payout, category FROM l WHERE author = 7 AND NOT paid ORDER BY payout DESC, id DESC LIMIT 20",
    "account_feed": _feed("LIMIT 50"),
    "account_feed_page_two": _feed("LIMIT 5 OFFSET 5", "at_ > (SELECT max(created) FROM l) - INTERVAL 30 DAY"),
    "blog_entries": f"""WITH {_P}, e AS (SELECT *, row_number() OVER (ORDER BY created, id)::INT - 1 AS entry FROM l WHERE author = 7)
      SELECT author, entry, id, created FROM e WHERE entry > (SELECT max(entry) FROM e) - 10""",
    "account_info": f"""WITH {_P}, {_V}, a AS (SELECT author, count(*) AS n, max(created) AS lp FROM l GROUP BY 1), b AS (SELECT author, max(at_) AS lv FROM v JOIN l ON v.post = l.id GROUP BY 1)
      SELECT c_custkey AS account, c_name AS name, coalesce(n, 0) AS post_count, greatest(lp, lv) AS active_at FROM customer LEFT JOIN a ON a.author = c_custkey LEFT JOIN b ON b.author = c_custkey""",
    "reputation_display": f"""WITH a AS (SELECT c_custkey AS account, {_RAW} AS raw FROM customer),
      b AS (SELECT *, length(abs(raw)::VARCHAR) AS d, log10(CASE WHEN abs(raw) >= 1000 THEN left(abs(raw)::VARCHAR, 4)::INT ELSE abs(raw) * pow(10, 4 - length(abs(raw)::VARCHAR)) END) + 0.00000001 AS t FROM a)
      SELECT account, raw, CASE WHEN raw = 0 THEN 25 ELSE round(CASE WHEN raw < 0 THEN -1 ELSE 1 END * greatest(d - 1 + t - floor(t) - 9, 0) * 9 + 25, 2) END::DOUBLE AS reputation,
        CASE WHEN raw = 0 THEN 25 ELSE round(greatest(log10(abs(raw)) - 9, 0) * sign(raw) * 7.5 + 25)::INT END AS score FROM b""",
    "profile_fields": """SELECT c_custkey AS account, c_name AS name, c_mktsegment || ' ' || c_name AS about, 'http://' || c_mktsegment || '.example.org' AS website FROM customer""",
    "vote_rollup": f"WITH {_V}, {_R} SELECT * FROM r",
    "votes_by_comment_voter": f"""WITH {_V} SELECT post, voter, sum(rshares)::BIGINT AS rshares, max(at_) AS at, count(*) - 1 AS num_changes FROM v
      WHERE post > 100 OR (post = 100 AND voter >= 5) GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 1000""",
    "votes_by_voter_comment": f"WITH {_V} SELECT voter, post, sum(rshares)::BIGINT AS rshares, max(at_) AS at FROM v WHERE voter = 3 GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 1000",
    "vote_last_merge": f"""WITH {_V}, n AS (SELECT voter, post, count(*) - 1 AS num_changes FROM v GROUP BY 1, 2),
      a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY voter, post ORDER BY at_ DESC, rshares DESC) AS rn FROM v WHERE NOT effective) WHERE rn = 1),
      b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY voter, post ORDER BY at_ DESC, rshares DESC) AS rn FROM v WHERE effective) WHERE rn = 1)
      SELECT voter, post, num_changes, a.at_ AS plain_at, b.at_ AS effective_at, coalesce(b.rshares, a.rshares) AS rshares, b.post IS NOT NULL AS is_effective
      FROM a FULL JOIN b USING (voter, post) JOIN n USING (voter, post)""",
    "last_value_filter": f"""WITH {_V} SELECT post, last(rshares ORDER BY at_, rshares) FILTER (effective) AS last_effective, last(rshares ORDER BY at_, rshares) FILTER (rshares < 0) AS last_negative,
      bool_or(effective) AS any_effective, max(at_) AS last_at FROM v GROUP BY post""",
    "vote_value_score": f"""WITH {_P}, {_V}, {_R}, e AS (SELECT post, voter, sum(rshares)::BIGINT AS rs FROM v GROUP BY 1, 2),
      x AS (SELECT post, voter, CASE WHEN r.rshares <> 0 THEN payout::DOUBLE / r.rshares * rs ELSE 0 END AS value, abs_rshares, payout::DOUBLE / abs_rshares * 1000 * rs AS w FROM e JOIN r USING (post) JOIN l ON l.id = e.post)
      SELECT post, voter, round(value, 3) AS value, CASE WHEN abs_rshares = 0 THEN 0 WHEN w < 20 THEN -1 ELSE least(100, (length(round(w)::BIGINT::VARCHAR) - 1) * 25) END::INT AS score FROM x""",
    "first_last_dedup": """SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value, arg_min(value, event_id) AS first_value, count(*) - 1 AS num_changes FROM events GROUP BY 1, 2""",
    "latest_votes": f"""WITH {_V} SELECT voter, post, rshares, at_ AS at FROM (SELECT *, row_number() OVER (PARTITION BY voter ORDER BY at_ DESC, post DESC, rshares DESC) AS rn FROM v) WHERE rn = 1""",
    "payout_stats": f"""WITH {_P}, o AS (SELECT * FROM l WHERE NOT paid)
      SELECT community, author, sum(payout) AS payout, count(*) AS posts, NULL::BIGINT AS authors FROM o GROUP BY community, author
      UNION ALL SELECT community, NULL, sum(payout), count(*), count(DISTINCT author) FROM o GROUP BY community""",
    "payout_totals": f"WITH {_P} SELECT sum(payout) AS total, sum(payout) FILTER (parent IS NULL) AS blogs, count(*) AS posts FROM l WHERE NOT paid",
    "community_rank": f"WITH {_P}, {_RANK} SELECT * FROM k2",
    "communities_keyset": f"""WITH {_P}, {_RANK}, a AS (SELECT s_nationkey, string_agg(s_name, ',' ORDER BY s_name) AS admins FROM (
        SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rn FROM supplier) WHERE rn <= 3 GROUP BY 1)
      SELECT community, title, rank, admins FROM (SELECT * FROM k2 WHERE rank > 5 ORDER BY rank LIMIT 10) LEFT JOIN a ON s_nationkey = community""",
    "pop_communities": f"""WITH {_P} SELECT community, n_name AS title, count(*) AS newcomers FROM l JOIN nation ON n_nationkey = community
      WHERE created > (SELECT max(created) FROM l) - INTERVAL 1 MONTH GROUP BY 1, 2 ORDER BY 3 DESC, 1 DESC LIMIT 25""",
    "trending_tags": f"""WITH {_P}, {_G} SELECT tag, count(*) AS comments, count(*) FILTER (parent IS NULL) AS top_posts, sum(payout) AS total_payouts
      FROM g JOIN l ON g.post = l.id WHERE NOT paid GROUP BY tag HAVING sum(payout) > 0 ORDER BY 4 DESC, 1 DESC LIMIT 250""",
    "trending_topics": f"""WITH {_P}, {_RANK} SELECT * FROM (SELECT * FROM (SELECT title AS name, rank AS place FROM k2 ORDER BY rank LIMIT 10)
      UNION ALL VALUES {", ".join(f"('{t}', {1000 + i})" for i, t in enumerate(FALLBACK_TOPICS))}) ORDER BY place LIMIT 15""",
    "subscribers_roles": """SELECT c_name AS name, CASE WHEN c_acctbal < 0 THEN 'muted' WHEN c_custkey % 97 = (SELECT max(s_suppkey) FROM supplier WHERE s_nationkey = 7) % 97 THEN 'mod' ELSE 'guest' END AS role
      FROM customer WHERE c_nationkey = 7 AND c_name > 'Customer#000000100' ORDER BY 1 LIMIT 100""",
    "discussion_tree": f"""WITH RECURSIVE {_P}, {_M}, {_FN}, {_MB}, n AS (SELECT id, parent, author FROM l WHERE author NOT IN (SELECT muted FROM mb)),
      t(id, depth) AS (SELECT id, 0 FROM n WHERE id = 0 UNION ALL SELECT n.id, t.depth + 1 FROM t JOIN n ON n.parent = t.id),
      c AS (SELECT parent, string_agg(n.id::VARCHAR, ',' ORDER BY n.id) AS replies FROM n JOIN t USING (id) WHERE depth > 0 GROUP BY parent)
      SELECT n.id, n.author, depth, coalesce(replies, '') AS replies FROM n JOIN t USING (id) LEFT JOIN c ON c.parent = n.id""",
    "children_counts": f"""WITH RECURSIVE {_P}, n AS (SELECT id, parent FROM l), {_WALK}, b AS (SELECT above, count(*) AS c FROM walk GROUP BY 1)
      SELECT id, coalesce(c, 0) AS children FROM n LEFT JOIN b ON above = id""",
    "muted_propagation": f"""WITH RECURSIVE {_P}, n AS (SELECT id, parent, (CASE WHEN grayed THEN 8 ELSE 0 END | CASE WHEN community % 7 = 0 THEN 2 ELSE 0 END) AS own FROM p), {_WALK},
      h AS (SELECT DISTINCT w.id FROM walk w JOIN n ON n.id = w.above WHERE own <> 0)
      SELECT n.id, n.own | CASE WHEN h.id IS NOT NULL THEN 4 ELSE 0 END AS reasons FROM n LEFT JOIN h USING (id)""",
    "notification_ids": f"""WITH e AS (SELECT event_id, ts, {_KIND} AS kind, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY event_id)::INT AS counter FROM events)
      SELECT event_id, ((floor(epoch(ts))::BIGINT - epoch(TIMESTAMP '{GENESIS}')::BIGINT) * 64 + kind) * 4194304 + counter AS id, date_trunc('second', ts)::TIMESTAMP AS created, kind, counter FROM e""",
    "notification_messages": f"""WITH e AS (SELECT *, {_KIND} AS kind FROM events),
      x AS (SELECT *, CASE WHEN kind IN (10, 17) THEN json_extract_string(props, '$.k') END AS payload FROM e)
      SELECT event_id, kind, replace(replace({_TEMPLATE} || CASE WHEN kind = 17 AND payload <> '' THEN ' <payload>' ELSE '' END, '<src>', '@user' || user_id), '<payload>', coalesce(payload, 'null')) AS msg FROM x""",
    "account_notifications": f"""SELECT event_id, {_KIND} AS kind, least(100, floor(value)::INT) AS score, ts FROM events WHERE user_id = 7 AND floor(value) >= 25 ORDER BY event_id DESC LIMIT 50""",
    "unread_asof": """SELECT user_id, arg_max(event_id, ts) FILTER (ts <= TIMESTAMP '2024-01-15') AS last_read, count(*) FILTER (ts > TIMESTAMP '2024-01-15') AS unread FROM events GROUP BY 1""",
    "block_lag": "SELECT event_id, ts, coalesce(lag(ts) OVER (PARTITION BY user_id ORDER BY event_id), ts) AS previous FROM events",
    "op_history": """SELECT user_id, at_::INT AS at, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS at_ FROM events) WHERE at_ BETWEEN 21 AND 30""",
    "json_props": """SELECT json_extract_string(props, '$.k')::INT AS k, count(*) AS n, sum(value::DECIMAL(18,4))::DECIMAL(28,4) AS total FROM events
      WHERE event_type <> 'error' AND json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1""",
    "muted_reason_mask": """SELECT doc_id, (CASE WHEN toxic = 1 THEN 1 ELSE 0 END + CASE WHEN quality = 0 THEN 4 ELSE 0 END) AS mask,
      concat_ws(',', CASE WHEN toxic = 1 THEN 'MUTED_COMMUNITY_MODERATION' END, CASE WHEN quality = 0 THEN 'MUTED_PARENT' END) AS reasons FROM labels WHERE toxic = 1 OR quality = 0""",
    "search_bm25": f"""WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
      c AS (SELECT id, len(w) AS length, {_counts(QUERY)} FROM d), t AS (SELECT count(*) AS total, avg(length) AS average, {_frequencies(len(QUERY))} FROM c)
      SELECT id, round({_bm25(len(QUERY))}, 6) AS score FROM c, t WHERE round({_bm25(len(QUERY))}, 6) > 0 ORDER BY 2 DESC, 1 DESC LIMIT 20""",
    "search_query": """WITH d AS (SELECT doc_id, lang, ' ' || array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), ' ') || ' ' AS t FROM documents)
      SELECT doc_id FROM d WHERE (contains(t, ' the ') OR lower(lang) = 'the') AND NOT (contains(t, ' idiot ') OR lower(lang) = 'idiot') AND lower(lang) = 'en'""",
    "tag_normalise": r"""WITH d AS (SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(string_split(coalesce(text, ''), ' '), lambda x: left(lower(regexp_replace(x, '[#\s]', '', 'g')), 32)), lambda x: x <> ''))) AS t FROM documents)
      SELECT doc_id, len(t)::INT AS n_tags, md5(array_to_string(t, ',')) AS tags_md5 FROM d""",
    "ranked_without_reasons": _top(_SCORED, "s WHERE NOT paid AND parent IS NULL AND NOT grayed AND coalesce(community % 7, 1) <> 0", "sc_trend"),
    "ranked_payout_roots": _top(_P, "l WHERE NOT paid AND parent IS NULL", "payout"),
    "account_blog": f"""WITH {_P}, e AS (SELECT id, created AS at_ FROM l WHERE parent IS NULL AND author = 7 UNION ALL SELECT parent, min(created) FROM l WHERE parent IS NOT NULL AND author = 7 GROUP BY 1)
      SELECT l.id, l.author, min(at_) AS entered FROM e JOIN l USING (id) GROUP BY 1, 2 ORDER BY 3 DESC, 1 DESC LIMIT 20""",
    "account_blog_bridge": f"""WITH {_P}, e AS (SELECT id, created AS at_, FALSE AS shared FROM l WHERE parent IS NULL AND author = 7 UNION ALL SELECT parent, min(created), TRUE FROM l WHERE parent IS NOT NULL AND author = 7 GROUP BY 1)
      SELECT l.id, l.author, min(at_) AS entered FROM e JOIN l USING (id) GROUP BY 1, 2 HAVING bool_or(shared) OR any_value(community) % 5 = 0 OR any_value(community) IS NULL ORDER BY 3 DESC, 1 DESC LIMIT 20""",
    "account_comments": f"WITH {_P} SELECT id, parent, created FROM l WHERE author = 7 AND parent IS NOT NULL ORDER BY id DESC LIMIT 20",
    "account_posts_by_tag": f"WITH {_P}, {_G} SELECT id, created, category FROM l WHERE author = 7 AND id IN (SELECT post FROM g WHERE tag = 'Brand#21') ORDER BY id DESC LIMIT 20",
    "account_posts_before": f"WITH {_P} SELECT id, created, payout FROM l WHERE author = 6 AND parent IS NULL AND created < TIMESTAMP '2000-01-01' ORDER BY created DESC, id DESC LIMIT 10",
    "active_votes": f"""WITH {_P}, {_V}, o AS (SELECT * FROM v WHERE post = 1), w AS (SELECT sum(rshares)::BIGINT AS whole, any_value(payout) AS payout FROM o JOIN p ON p.id = o.post)
      SELECT voter, sum(rshares)::BIGINT AS rshares, max(at_) AS at, round(CASE WHEN any_value(whole) <> 0 THEN any_value(payout)::DOUBLE / any_value(whole) * sum(rshares)::BIGINT ELSE 0 END, 3) AS value FROM o, w GROUP BY voter""",
    "community_roles": """SELECT * FROM (SELECT c_name AS name, CASE WHEN c_acctbal < 0 THEN 'muted' WHEN c_custkey % 97 = (SELECT max(s_suppkey) FROM supplier WHERE s_nationkey = 7) % 97 THEN 'mod' ELSE 'guest' END AS role
      FROM customer WHERE c_nationkey = 7) WHERE role <> 'guest' ORDER BY 1 LIMIT 100""",
    "all_subscriptions": """SELECT n_nationkey AS community, n_name AS title, CASE WHEN c_acctbal < 0 THEN 'muted' WHEN c_custkey % 97 = (SELECT max(s_suppkey) FROM supplier WHERE s_nationkey = c_nationkey) % 97 THEN 'mod' ELSE 'guest' END AS role
      FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 7""",
    "community": f"WITH {_P}, {_RANK} SELECT * FROM k2 WHERE community = 7",
    "community_context": """SELECT coalesce(max(CASE WHEN c_acctbal < 0 THEN 'muted' WHEN c_custkey % 97 = (SELECT max(s_suppkey) FROM supplier WHERE s_nationkey = 7) % 97 THEN 'mod' ELSE 'guest' END), 'guest') AS role,
      count(*) > 0 AS subscribed FROM customer WHERE c_nationkey = 7 AND c_custkey = 7""",
    "following_page": f"WITH {_F} SELECT c_name AS name FROM customer WHERE c_custkey IN (SELECT following FROM f WHERE follower = 3) ORDER BY 1 LIMIT 100",
    "follow_list": f"WITH {_M} SELECT c_name AS name, 'muted' AS kind FROM customer WHERE c_custkey IN (SELECT following FROM m WHERE follower = 1)",
    "follows_any_lists": f"""WITH {_M}, {_FN}, z AS (SELECT DISTINCT m.follower AS list, c_nationkey AS nation FROM m JOIN customer ON following = c_custkey)
      SELECT s_suppkey AS account, bool_or(fm.following IS NOT NULL) AS any_list, bool_and(list IS NOT NULL) FILTER (fm.following IS NOT NULL) AS all_near
      FROM supplier LEFT JOIN fm ON follower = s_suppkey LEFT JOIN z ON list = fm.following AND nation = s_nationkey GROUP BY 1""",
    "post_notifications": f"""WITH {_P}, {_V}, o AS (SELECT * FROM v WHERE post = 1), b AS (SELECT sum(abs(rshares))::BIGINT AS abs_rshares FROM o), q AS (SELECT payout, parent IS NULL AS is_root FROM l WHERE id = 1),
      e AS (SELECT voter, sum(rshares)::BIGINT AS rs FROM o GROUP BY 1), x AS (SELECT voter, abs_rshares, payout::DOUBLE / abs_rshares * 1000 * rs AS w FROM e, b, q),
      n AS (SELECT CASE WHEN is_root THEN 12 ELSE 13 END AS kind, author AS src, 100 AS score FROM l, q WHERE parent = 1
        UNION ALL SELECT 17, voter, CASE WHEN abs_rshares = 0 THEN 0 WHEN w < 20 THEN -1 ELSE least(100, (length(round(w)::BIGINT::VARCHAR) - 1) * 25) END::INT FROM x)
      SELECT * FROM n WHERE kind < 17 OR score >= 0 ORDER BY kind, score DESC, src DESC LIMIT 50""",
    "post": f"""WITH {_SCORED} SELECT s.id, a.c_name AS author_name, n_name AS community_title, r_name AS region_name, s.category, s.payout, round(sc_trend::DOUBLE, 3) AS score, s.parent, b.c_name AS parent_author
      FROM s LEFT JOIN customer a ON a.c_custkey = s.author LEFT JOIN nation ON n_nationkey = a.c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
      LEFT JOIN p q ON q.id = s.parent LEFT JOIN customer b ON b.c_custkey = q.author WHERE s.id = 1""",
    "post_header": f"WITH {_P} SELECT id, author, category, parent IS NULL AS is_root FROM l WHERE id = 1",
    "content_replies": f"WITH {_P} SELECT id, author, created, payout FROM l WHERE parent = 1 ORDER BY id LIMIT 5000",
    "reblogged_by": f"WITH {_P} SELECT c.author AS account, min(c.created) AS at FROM l c JOIN l o ON o.id = c.parent WHERE c.parent = 1 AND c.author <> o.author GROUP BY 1",
    "find_comments": f"WITH {_P} SELECT id, author, payout FROM l WHERE author BETWEEN 1 AND 100 AND id BETWEEN 1 AND 100",
    "posts_of_categories": f"WITH {_P} SELECT category, count(*) AS n FROM l WHERE parent IS NULL AND category IN ('1-URGENT', '5-LOW') GROUP BY 1",
    "info": f"WITH {_P} SELECT max(created) AS head, max(id) AS last_id, count(*) AS posts FROM p",
    "changed_parents": f"""WITH {_P} SELECT c.category, count(*) AS n FROM p c JOIN p o ON o.id = c.parent
      WHERE c.community IS DISTINCT FROM CASE WHEN o.community % 5 = 0 THEN NULL ELSE o.community END OR c.category IS DISTINCT FROM o.category GROUP BY 1""",
    "quiet_followers": f"""WITH {_P}, {_F} SELECT DISTINCT follower FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.follower = a.follower
      AND NOT EXISTS (SELECT 1 FROM l WHERE l.author = b.following AND NOT l.paid))""",
    "payouts_by_place": f"""WITH {_P}, s AS (SELECT community, sum(payout) AS payout FROM l WHERE NOT paid GROUP BY 1)
      SELECT n_nationkey AS nation, sum(payout)::DECIMAL(30,3) AS payout, count(community) AS communities FROM nation LEFT JOIN s ON CASE WHEN n_nationkey % 7 = 0 THEN TRUE ELSE community = n_nationkey END GROUP BY 1""",
    "sequence_ids": f"WITH {_P} SELECT id, row_number() OVER (ORDER BY created, id) AS number FROM p",
    "first_occurrences": f"WITH {_P} SELECT id, row_number() OVER (PARTITION BY author, category ORDER BY created, id) = 1 AS is_first FROM l",
    "waves": f"""WITH RECURSIVE {_P}, t(id, depth) AS (SELECT id, 0 FROM p WHERE parent IS NULL UNION ALL SELECT p.id, t.depth + 1 FROM t JOIN p ON p.parent = t.id) SELECT depth AS wave, count(*) AS n FROM t GROUP BY 1""",
    "child_deltas": f"""WITH RECURSIVE {_P}, n AS (SELECT id, parent FROM l), {_WALK}
      SELECT above AS id, count(*) AS delta FROM walk JOIN n ON n.id = above WHERE walk.id > (SELECT max(id) * 9 / 10 FROM n) GROUP BY 1""",
    "retained_events": "SELECT event_type, count(*) AS n FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 10 DAY GROUP BY 1",
    "next_orders": f"WITH {_P} SELECT a.id, b.created AS next_created FROM p a LEFT JOIN p b ON b.id = a.id + 1",
    "post_mentions": rf"""WITH {_P}, m AS (
        SELECT id, 'c' || author AS self, unnest(list_distinct(list_transform(regexp_extract_all('Thanks @C' || author || ', @c' || (author % 97 + 1) || ' and @nobody' || (author % 5) || '; mail me@c1.com. (@c' || (id % 13 + 1) || ')',
          '(?:^|[^a-zA-Z0-9_!#$%&*@\\/])(?:@)([a-zA-Z0-9\.-]{{1,16}}[a-zA-Z0-9])', 1), lambda x: lower(x)))) AS mention FROM l)
      SELECT id, mention FROM m WHERE mention <> self AND mention IN (SELECT 'c' || c_custkey FROM customer)""",
    "fold_accounts": f"""SELECT 'c' || c_custkey AS name, {_at("c_custkey % 100")} AS created, CASE WHEN c_custkey % 3 = 0 THEN '{{"profile":{{"name":"' || c_name || '"}}}}' END AS posting_metadata, NULL::VARCHAR AS json_metadata,
      (1000000 + c_custkey % 100 + CASE WHEN c_custkey % 3 = 0 THEN 200 ELSE 0 END)::INT AS block_num FROM customer""",
    "fold_votes": f"""WITH o AS (SELECT *, {_day("l_shipdate")} AS d, {_day("l_shipdate")}::HUGEINT * 1000000000000 + (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey % 100000 AS op FROM lineitem)
      SELECT 's' || l_suppkey AS voter, 'x' || (l_orderkey % 100) AS author, 'p' || l_orderkey AS permlink, arg_max(l_partkey, op) FILTER (l_linestatus = 'F') AS weight,
        coalesce(arg_max(round(l_extendedprice * 100)::BIGINT, op) FILTER (l_linestatus = 'F'), 0) AS rshares, arg_max((l_quantity * 100)::INT, op) AS percent, {_at("arg_max(d, op)")} AS last_update,
        (count(*) - 1)::INT AS num_changes, bool_or(l_linestatus = 'F') AS is_effective, (1000000 + max(d))::INT AS block_num FROM o GROUP BY l_suppkey, l_orderkey""",
    "fold_posts": f"""WITH o AS (SELECT *, {_day("o_orderdate")} AS d FROM orders), g AS (SELECT *, 0 AS generation FROM o UNION ALL SELECT *, 1 FROM o WHERE o_orderkey % 100 = 7)
      SELECT 'c' || o_custkey AS author, 'p' || o_orderkey AS permlink, generation, CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE 'x' END AS parent_author, o_orderpriority AS title,
        CASE WHEN generation = 1 THEN 'r' WHEN o_orderkey % 4 = 0 THEN 'e' ELSE 'b' END || o_orderkey AS body, left(replace(lower(o_orderpriority), ' ', ''), 32) || ',t' || (o_orderkey % 5) AS tags,
        {_at("d + generation")} AS created, o_orderkey % 50 = 7 AND generation = 0 AS deleted, (1000000 + d + generation)::INT AS block_num FROM g""",
    "fold_follows": f"""WITH {_F}, {_M}, a AS (
        SELECT *, (follower + following) % 100 AS d, 'follow' AS kind FROM f UNION ALL SELECT *, (follower + following) % 100 + 100, 'mute' FROM m
        UNION ALL SELECT *, (follower + following) % 100 + 200, NULL FROM f WHERE (follower + following) % 10 = 0),
      z AS (SELECT *, row_number() OVER (PARTITION BY follower, following ORDER BY d DESC) AS rn FROM a)
      SELECT 's' || follower AS follower, 'c' || following AS following, kind, (1000000 + d)::INT AS block_num FROM z WHERE rn = 1 AND kind IS NOT NULL AND (follower % 13 <> 0 OR d >= 150)""",
    "fold_reblogs": f"""WITH {_P}, o AS (SELECT author, parent, {_day("created")} AS d, {_day("created")}::HUGEINT * 10000000000 + id * 2 AS op, FALSE AS gone FROM p WHERE parent IS NOT NULL
        UNION ALL SELECT author, parent, {_day("created")} + 1, ({_day("created")} + 1)::HUGEINT * 10000000000 + id * 2 + 1, TRUE FROM p WHERE parent IS NOT NULL AND id % 6 = 0),
      c AS (SELECT *, max(CASE WHEN gone THEN op END) OVER (PARTITION BY author, parent) AS cleared FROM o)
      SELECT 'c' || author AS account, 'x' || (parent % 100) AS author, 'p' || parent AS permlink, {_at("min(d) FILTER (NOT gone AND op > coalesce(cleared, 0))")} AS created, (1000000 + max(d))::INT AS block_num
      FROM c GROUP BY author, parent HAVING NOT arg_max(gone, op)""",
    "fold_payouts": f"""WITH o AS (SELECT *, {_day("o_orderdate")} AS d, o_orderstatus = 'F' AS f FROM orders)
      SELECT 'c' || o_custkey AS author, 'p' || o_orderkey AS permlink, CASE WHEN f THEN round(o_totalprice * 1000)::BIGINT / 1000.0 ELSE 0 END::DECIMAL(20,3) AS payout,
        CASE WHEN f THEN 0 ELSE round(o_totalprice * 500)::BIGINT / 1000.0 END::DECIMAL(20,3) AS pending, f AS is_paid, CASE WHEN f THEN {_at("d + 7")} END AS last_payout, (1000000 + d + CASE WHEN f THEN 7 ELSE 0 END)::INT AS block_num FROM o""",
    "fold_communities": """WITH n AS (SELECT *, 'hive-1' || lpad(n_nationkey::VARCHAR, 5, '0') AS community FROM nation)
      SELECT community, 'role' AS kind, community AS key, 'owner' AS value FROM n
      UNION ALL SELECT community, 'role', 's' || s_suppkey, CASE WHEN s_suppkey % 2 = 1 THEN 'mod' ELSE 'member' END FROM supplier JOIN n ON n_nationkey = s_nationkey
      UNION ALL SELECT community, 'subscriber', 'c' || c_custkey, '' FROM customer JOIN n ON n_nationkey = c_nationkey WHERE c_custkey % 5 <> 0
      UNION ALL SELECT community, 'prop', 'title', n_name FROM n""",
    "vote_notifications": f"""WITH {_P}, {_V}, {_R}, {_M}, e AS (SELECT post, voter, sum(rshares)::BIGINT AS rs FROM v GROUP BY 1, 2),
      x AS (SELECT post, voter, author, rs, CASE WHEN r.rshares <> 0 THEN payout::DOUBLE / r.rshares * rs ELSE 0 END AS value, abs_rshares, payout::DOUBLE / abs_rshares * 1000 * rs AS w FROM e JOIN r USING (post) JOIN l ON l.id = e.post),
      y AS (SELECT *, CASE WHEN abs_rshares = 0 THEN 0 WHEN w < 20 THEN -1 ELSE least(100, (length(round(w)::BIGINT::VARCHAR) - 1) * 25) END::INT AS score FROM x)
      SELECT post, voter, score, round(value, 3) AS value FROM y
      WHERE score >= 0 AND rs * 1000 >= 10000000000 AND value >= 0.02 AND voter <> author AND NOT EXISTS (SELECT 1 FROM m WHERE m.following = y.author AND m.follower = y.voter)""",
}

SQL |= {name: _search(**asked) for name, asked in search.SEARCHES.items()}
SQL |= {
    "search_page_two": _search("the of", page=2),
    "text_index_search": _search(text_index.QUERY),
    "text_index_terms": """WITH d AS (SELECT unnest(['title', 'body', 'lang']) AS field, unnest([list_distinct(regexp_extract_all(lower(split_part(coalesce(text, ''), chr(10), 1)), '[a-z0-9]+')),
        list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(coalesce(lang, '')), '[a-z0-9]+'))]) AS w FROM documents)
      SELECT field, term, count(*) AS docs FROM (SELECT field, unnest(w) AS term FROM d) GROUP BY 1, 2""",
}

# Notifications of logs made from the tables: blocks are days, and an id is time, type and counter in one number.
_REP = """rep AS (SELECT name, round(CASE WHEN raw <> 0 THEN greatest(log10(abs(raw)::DOUBLE) - 9, 0) ELSE 0 END * CASE WHEN raw < 0 THEN -1 ELSE 1 END * 7.5 + 25)::INT AS score FROM (
    SELECT 'c' || c_custkey AS name, round(c_acctbal * 100)::BIGINT * 1000000000 AS raw FROM customer UNION ALL SELECT 's' || s_suppkey, round(s_acctbal * 100)::BIGINT * 1000000000 FROM supplier))"""
_MM = f"""{_M}, mu AS (SELECT 'c' || following AS a, 's' || follower AS b FROM m UNION SELECT 'c' || c_custkey, 'c' || (c_custkey % 97 + 1) FROM customer WHERE c_custkey % 4 = 0 AND c_custkey <> c_custkey % 97 + 1),
  mm AS (SELECT a, b FROM mu UNION SELECT 'c' || c_custkey, mu.b FROM customer JOIN mu ON mu.a = 'c' || (c_custkey % 50 + 1) WHERE c_custkey % 3 = 0 AND c_custkey <> c_custkey % 50 + 1)"""
#: Posts of ``threads`` up to day 2300, by generation.
_T = f"""o AS (SELECT o_orderkey AS k, o_custkey AS c, {_day("o_orderdate")} AS d, o_orderstatus = 'F' AS f, o_totalprice AS price FROM orders),
  g AS (SELECT *, 0 AS generation FROM o WHERE d <= 2300 UNION ALL SELECT *, 1 FROM o WHERE k % 100 = 7 AND d < 2300),
  t AS (SELECT g.k, g.c, 'c' || g.c AS author, 'p' || g.k AS permlink, g.generation, g.d + g.generation AS d, up.c AS up_c, up.k AS up_k, up.d AS up_d, g.k % 50 = 7 AND g.generation = 0 AS deleted, g.f, g.price
    FROM g LEFT JOIN o up ON g.k % 10 <> 0 AND up.k = g.k // 3)"""


def _notices(ctes: str, rows: str, kind: str, created: str = "d - 1", scored: bool = True) -> str:
    """The notifications of rows (d, counter, src, dst, author, permlink, payload) that are told."""
    score = "rep.score" if scored else "x.score"
    told = "rep.score > 0 AND NOT EXISTS (SELECT 1 FROM mm WHERE mm.a = x.dst AND mm.b = x.src)" if scored else "TRUE"
    return f"""WITH {_MM}, {_REP}, {ctes}, x AS ({rows})
      SELECT (epoch({_at(created)})::BIGINT - epoch(TIMESTAMP '{GENESIS}')::BIGINT) * 268435456 + ({kind})::BIGINT * 4194304 + counter AS id, ({kind})::INT AS type_id, (1000000 + d)::INT AS block_num, {_at(created)} AS created,
        src, dst, author, permlink, ({score})::INT AS score, payload FROM x JOIN rep ON rep.name = src WHERE src <> dst AND {told}"""


SQL |= {
    "notices_subscribe": _notices("n AS (SELECT 1)", "SELECT 1 AS d, row_number() OVER (ORDER BY c_custkey) AS counter, 'c' || c_custkey AS src, 'hive-1' || lpad(c_nationkey::VARCHAR, 5, '0') AS dst, '' AS author, '' AS permlink, '' AS payload FROM customer", "11"),
    "notices_follow": _notices(_F, """SELECT * FROM (SELECT (follower + following) % 100 AS d, row_number() OVER (PARTITION BY (follower + following) % 100 ORDER BY follower, following) AS counter, 's' || follower AS src, 'c' || following AS dst,
        '' AS author, '' AS permlink, '' AS payload FROM f) WHERE d > 30""", "15"),
    "notices_reply": _notices(_T, """SELECT * FROM (SELECT d, row_number() OVER (PARTITION BY d ORDER BY author, permlink, generation) AS counter, author AS src, 'c' || up_c AS dst, author, permlink, '' AS payload, up_d,
        CASE WHEN up_k % 10 = 0 OR NOT EXISTS (SELECT 1 FROM o WHERE o.k = up_k // 3) THEN 12 ELSE 13 END AS kind FROM t WHERE up_k IS NOT NULL) WHERE d > 2210 AND up_d <= 2300""", "kind"),
    "notices_reblog": _notices(_T, """SELECT * FROM (SELECT d, row_number() OVER (PARTITION BY d ORDER BY src, dst, permlink) AS counter, src, dst, dst AS author, permlink, '' AS payload, at_ FROM (
        SELECT max(g.d) + 2 AS d, min(g.d) + 2 AS at_, 'c' || g.c AS src, 'c' || up.c AS dst, 'p' || up.k AS permlink FROM o g JOIN o up ON g.k % 10 <> 0 AND up.k = g.k // 3 WHERE g.d + 2 <= 2300 AND up.d <= 2300 GROUP BY g.c, up.c, up.k)) WHERE d > 2210""", "14", "at_"),
    "notices_mention": _notices(_T, r"""SELECT * FROM (SELECT d, row_number() OVER (PARTITION BY d ORDER BY author, permlink, dst) AS counter, author AS src, dst, author, permlink, '' AS payload FROM (
        SELECT d, author, permlink, unnest(list_distinct(['c' || (c % 97 + 1), 'c' || (k % 13 + 1)])) AS dst FROM t WHERE NOT deleted) WHERE dst <> author AND dst IN (SELECT name FROM rep)) WHERE d > 2210""", "16"),
    "notices_vote": _notices(f"""{_T}, i AS (SELECT *, {_day("l_shipdate")} AS d, {_day("l_shipdate")}::HUGEINT * 1000000000000 + (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey % 100000 AS op FROM lineitem),
      v AS (SELECT l_suppkey AS s, l_orderkey AS k, coalesce(arg_max(round(l_extendedprice * 100)::BIGINT * 10000, op) FILTER (l_linestatus = 'F'), 0) AS rs, max(d) AS d FROM i WHERE d <= 2300 GROUP BY 1, 2),
      live AS (SELECT DISTINCT k, author, permlink FROM t WHERE NOT deleted AND d > 2203),
      worth AS (SELECT k, CASE WHEN f AND d + 7 <= 2300 THEN round(price * 1000)::BIGINT / 1000.0 ELSE round(price * 500)::BIGINT / 1000.0 END AS w FROM o WHERE d <= 2300),
      j AS (SELECT v.*, author, permlink, sum(rs) OVER (PARTITION BY k) AS whole, sum(abs(rs)) OVER (PARTITION BY k) AS size FROM v JOIN live USING (k)),
      h AS (SELECT d, 2 * row_number() OVER (PARTITION BY d ORDER BY 's' || s, author, permlink) AS counter, 's' || s AS src, author AS dst, author, permlink, rs, k, whole, size FROM j WHERE d > 2210 AND NOT EXISTS (SELECT 1 FROM mm WHERE mm.a = author AND mm.b = 's' || s)),
      q AS (SELECT h.*, CASE WHEN whole <> 0 THEN w::DOUBLE / whole * rs ELSE 0 END AS value, CASE WHEN size = 0 THEN 0 ELSE w::DOUBLE / size * 1000 * rs END AS units FROM h JOIN worth USING (k))""",
      """SELECT *, CASE WHEN size = 0 THEN 0 WHEN units < 20 THEN -1 ELSE least(100, (length(round(units)::BIGINT::VARCHAR) - 1) * 25) END AS score, CASE WHEN value < 0.01 THEN '' ELSE '($' || round(value::VARCHAR::DECIMAL(30,12), 2)::DECIMAL(30,2) || ')' END AS payload
        FROM q WHERE rs >= 10000000000 AND value >= 0.02 AND NOT (size <> 0 AND units < 20)""", "17", "d", False),
}

SQL["post_places"] = f"""WITH RECURSIVE o AS (SELECT o_orderkey AS k, o_custkey AS c, {_day("o_orderdate")} AS d, coalesce(c_nationkey, 0) AS n FROM orders LEFT JOIN customer ON c_custkey = o_custkey),
  t AS (SELECT g.*, 0 AS generation, k * 10 AS at_ FROM o g UNION ALL SELECT k, c, d + 1, n, 1, k * 10 + 3 FROM o WHERE k % 100 = 7),
  u AS (SELECT t.*, p.k AS up, generation = max(generation) OVER (PARTITION BY t.k) AS is_last FROM t LEFT JOIN o p ON t.k % 10 <> 0 AND p.k = t.k // 3),
  w(k, generation, c, d, at_, is_last, root, n, depth) AS (SELECT k, generation, c, d, at_, is_last, k, n, 0 FROM u WHERE up IS NULL
    UNION ALL SELECT u.k, u.generation, u.c, u.d, u.at_, u.is_last, w.root, w.n, w.depth + 1 FROM u JOIN w ON w.k = u.up AND w.is_last),
  r AS (SELECT w.*, 1 + n % 3 AS kind, c % 6 = 0 AND c IN (SELECT c_custkey FROM customer WHERE c_nationkey = n) AND (c % 1000, c) < (d, at_) AND NOT (c % 12 = 0 AND (c % 1000 + 700, c) < (d, at_)) AS member FROM w),
  m AS (SELECT *, CASE WHEN NOT member AND (kind = 3 OR kind = 2 AND depth = 0) THEN 2 ELSE 0 END AS own FROM r),
  x(k, generation, is_last, reasons) AS (SELECT k, generation, is_last, own FROM m WHERE depth = 0
    UNION ALL SELECT m.k, m.generation, m.is_last, m.own + CASE WHEN x.reasons <> 0 THEN 4 ELSE 0 END FROM x JOIN m ON m.depth > 0 AND m.k % 10 <> 0 AND m.k // 3 = x.k AND x.is_last)
  SELECT 'c' || c AS author, 'p' || k AS permlink, generation, 'p' || root AS root_permlink, depth::INT AS depth, 'hive-' || kind || lpad(n::VARCHAR, 5, '0') AS community, reasons::INT AS reasons FROM m JOIN x USING (k, generation)"""

SQL["feed_entries"] = f"""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, {_day("o_orderdate")} AS d FROM orders),
  live AS (SELECT *, d + CASE WHEN k % 100 = 7 THEN 1 ELSE 0 END AS made FROM o WHERE k % 50 <> 7 OR k % 100 = 7),
  root AS (SELECT k FROM o WHERE k % 10 = 0 OR k // 3 NOT IN (SELECT k FROM o)),
  rb AS (SELECT a.c AS account, p.k, p.c, a.d + 2 AS d FROM o a JOIN o p ON a.k % 10 <> 0 AND p.k = a.k // 3 WHERE p.k % 50 <> 7 OR (a.d + 2, a.k) > (p.d, p.k * 10 + 2)),
  e AS (SELECT c AS account, c, k, made AS at_ FROM live WHERE k IN (SELECT k FROM root) UNION ALL SELECT rb.account, rb.c, rb.k, min(rb.d) FROM rb JOIN live USING (k) GROUP BY 1, 2, 3)
  SELECT 'c' || account AS account, 'c' || c AS author, 'p' || k AS permlink, {_at("min(at_)")} AS created FROM e GROUP BY account, c, k"""

SQL |= {
    "vote_sums": f"""SELECT author, permlink, sum(rshares)::BIGINT AS rshares, sum(abs(rshares))::BIGINT AS abs_rshares, count(*) FILTER (is_effective) AS total_votes, sum(sign(rshares))::BIGINT AS net_votes, count(*) AS votes
      FROM ({SQL["fold_votes"]}) GROUP BY 1, 2""",
    "follow_sums": f"""WITH e AS ({SQL["fold_follows"]}) SELECT follower AS account, 'following' AS side, count(*) AS n FROM e WHERE kind = 'follow' GROUP BY 1 UNION ALL SELECT following, 'followers', count(*) FROM e WHERE kind = 'follow' GROUP BY 1""",
}
