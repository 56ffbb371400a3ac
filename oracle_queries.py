"""The expected results, as SQL over the given tables.

Written independently of the Spark code: the raw tables and `messages` are common
table expressions, and every query selects from them.
"""

from __future__ import annotations

# Contact key of a user number.
_KEY = """(CASE WHEN {u} % 3 = 0 THEN 'user_' || {u} || '@example.com'
      ELSE '+1415' || lpad(CAST({u} AS VARCHAR), 10, '0') END)"""

_RAW = f"""
ev AS (
  SELECT event_id, user_id, event_type, value,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k,
         CAST(floor(epoch(ts)) AS BIGINT) - 978307200 AS sec
  FROM events),
users AS (SELECT DISTINCT user_id FROM events),
handle AS (SELECT user_id + 1 AS rowid_, {_KEY.format(u='user_id')} AS id FROM users),
chat_handle_join AS (
  SELECT user_id + 1 AS chat_id, user_id + 1 AS handle_id FROM users
  UNION ALL SELECT 1000000000 + user_id // 15, user_id + 1 FROM users
  UNION ALL SELECT 1000000000 + user_id // 15, -user_id - 1 FROM users),
chat_message_join AS (
  SELECT CASE WHEN event_type = 'purchase' THEN 1000000000 + user_id // 15
              WHEN event_type = 'signup' AND k = 93 THEN 2000000000 + user_id
              ELSE user_id + 1 END AS chat_id,
         event_id + 1 AS message_id
  FROM ev WHERE k <> 99
  UNION ALL
  SELECT 1000000000 + user_id // 15, event_id + 1 FROM ev
  WHERE k <> 99 AND event_type <> 'purchase' AND NOT (event_type = 'signup' AND k = 93) AND value > 150),
contacts AS (
  SELECT {_KEY.format(u='c_custkey')} AS contact_key, c_name AS name FROM customer
  WHERE c_mktsegment <> 'MACHINERY'),
message AS (
  SELECT event_id + 1 AS message_id,
         CASE WHEN event_id % 11 = 0 THEN NULL
              WHEN event_id % 7 <> 0 THEN event_type || ' ' || k
              ELSE event_type || ' ' || k || CASE k % 5
                WHEN 0 THEN ' see https://www.site' || (k % 10) || '.example.com/p/' || event_id || '.'
                WHEN 1 THEN ' (http://Shop.example.org:8080/a?b=c) ok'
                WHEN 2 THEN ' https://me:pw@cdn_' || k || '.example.net/x, y'
                WHEN 3 THEN ' http://first.example/ and https://second.example.com!'
                ELSE ' https:// nothing' END END AS text,
         CASE WHEN event_id % 11 = 0 THEN 'xxNSString+2' || event_type || ' hidden ' || k || 'NSDictionaryyy' END
           AS marked,
         CASE WHEN event_id % 11 <> 0 AND event_id % 13 = 0 THEN event_type || ' café ' || k END AS structured,
         CASE WHEN k = 94 THEN NULL WHEN event_id % 2 = 1 AND k >= 20 THEN 0 ELSE user_id + 1 END AS raw_handle,
         CASE WHEN k = 95 THEN NULL ELSE event_id % 2 END AS raw_from_me,
         CASE WHEN k = 98 THEN NULL WHEN k = 97 THEN 0 WHEN k = 96 THEN -2000000000
              WHEN event_id % 5 = 0 THEN sec ELSE sec * 1000000000 END AS raw_date,
         CASE WHEN k < 6 THEN 2000 + k WHEN k < 12 THEN 3000 + k - 6 ELSE 0 END AS code,
         CASE WHEN k = 12 THEN 'com.apple.MobileSMS.expressivesend.impact'
              WHEN k BETWEEN 13 AND 16 THEN 'com.apple.messages.effect.CK' || upper(event_type[1]) || event_type[2:]
                || 'Effect'
              WHEN k = 17 THEN 'trailing.' END AS style,
         CASE WHEN k BETWEEN 20 AND 29 THEN 'guid-' || event_id END AS guid,
         CASE WHEN event_id % 7 = 0 THEN 'URLBalloon' END AS balloon,
         CASE WHEN k = 30 THEN 1 ELSE 0 END AS audio
  FROM ev)
"""

# Last URL rules: a secure link first, cut at white space or ) > , ; and without . ! ? at its end.
_DOMAIN = r"""
  regexp_replace(lower(regexp_replace(regexp_replace(
    regexp_extract({token}, '^https?:[/\\]*([^/\\?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '^www\.', '')"""
_TOKEN = r"""
  rtrim(CASE WHEN contains({t}, 'https://') THEN regexp_extract({t}, 'https://[^\s)>,;]*')
             WHEN contains({t}, 'http://') THEN regexp_extract({t}, 'http://[^\s)>,;]*') END, '.!?')"""

_MESSAGES = (
    _RAW
    + """,
members AS (
  SELECT chat_id, COUNT(*) AS chat_size, MIN(id) AS only_member,
         CAST(to_json(list(handle_id ORDER BY handle_id)) AS VARCHAR) AS chat_members_handles,
         CAST(to_json(list(id ORDER BY handle_id)) AS VARCHAR) AS chat_members_contact_info
  FROM chat_handle_join j JOIN handle h ON j.handle_id = h.rowid_ GROUP BY chat_id),
first_chat AS (SELECT message_id, MIN(chat_id) AS chat_id FROM chat_message_join GROUP BY message_id),
texts AS (
  SELECT *, COALESCE(structured, regexp_extract(marked, 'NSString\\+2(.*)NSDictionary', 1)) AS inferred_text,
         CASE WHEN raw_date > 1000000000000 THEN raw_date // 1000000000 ELSE raw_date END + 978307200 AS unix_ts
  FROM message),
tokens AS (
  SELECT *, COALESCE(text, inferred_text) AS combined,
         CASE WHEN balloon IS NOT NULL THEN """
    + _TOKEN.format(t="COALESCE(text, inferred_text)")
    + """ END AS token,
         CASE WHEN unix_ts > 0 THEN make_timestamp(unix_ts * 1000000) END AS moment
  FROM texts),
messages AS (
  SELECT t.message_id,
    CAST(COALESCE(raw_from_me, 0) AS BIGINT) AS is_from_me,
    text, inferred_text, combined AS text_combined, combined AS body_text,
    CAST(COALESCE(raw_handle, 0) AS BIGINT) AS handle_id,
    h.id AS contact_info,
    CASE WHEN COALESCE(raw_from_me, 0) <> 1 THEN h.id
         WHEN m.chat_size = 1 THEN m.only_member WHEN m.chat_size > 1 THEN 'group-chat' END AS updated_contact_info,
    f.chat_id, m.chat_members_handles, m.chat_members_contact_info,
    COALESCE(m.chat_size, 0) AS chat_size,
    CAST(audio AS BIGINT) AS is_audio_message,
    CASE WHEN style IS NULL OR style LIKE '%.' THEN 'no-effect'
         ELSE replace(replace(regexp_extract(style, '[^.]*$'), 'CK', ''), 'Effect', '') END AS message_effect,
    CASE code WHEN 2000 THEN 'Loved' WHEN 2001 THEN 'Liked' WHEN 2002 THEN 'Disliked' WHEN 2003 THEN 'Laughed'
      WHEN 2004 THEN 'Emphasized' WHEN 2005 THEN 'Questioned' WHEN 3000 THEN 'Removed heart'
      WHEN 3001 THEN 'Removed like' WHEN 3002 THEN 'Removed dislike' WHEN 3003 THEN 'Removed laugh'
      WHEN 3004 THEN 'Removed emphasis' WHEN 3005 THEN 'Removed question mark' ELSE 'no-reaction' END AS reaction,
    CAST(guid IS NOT NULL AS BIGINT) AS is_thread_reply,
    CASE WHEN length("""
    + _DOMAIN.format(token="token")
    + """) > 0 THEN """
    + _DOMAIN.format(token="token")
    + """ END AS link_domain,
    COALESCE(c.name, h.id) AS name,
    CASE WHEN COALESCE(raw_from_me, 0) <> 1 THEN COALESCE(c.name, h.id)
         WHEN m.chat_size = 1 THEN COALESCE(p.name, m.only_member)
         WHEN m.chat_size > 1 THEN 'group-chat' END AS counterparty_name,
    CASE WHEN unix_ts > 0 THEN unix_ts END AS unix_ts,
    moment, CAST(moment AS DATE) AS date,
    CAST(month(moment) AS BIGINT) AS month, CAST(year(moment) AS BIGINT) AS year
  FROM tokens t
  LEFT JOIN handle h ON t.raw_handle = h.rowid_
  LEFT JOIN contacts c ON c.contact_key = h.id
  LEFT JOIN first_chat f ON f.message_id = t.message_id
  LEFT JOIN members m ON m.chat_id = f.chat_id
  LEFT JOIN contacts p ON p.contact_key = m.only_member)
"""
)


def _raw(sql: str) -> str:
    return f"WITH {_RAW} {sql}"


def _m(sql: str) -> str:
    return f"WITH {_MESSAGES} {sql}"


def _top(where: str = "") -> str:
    return _m(
        f"""SELECT name, COUNT(*) AS message_count FROM messages WHERE name IS NOT NULL {where}
        GROUP BY name ORDER BY message_count DESC, name LIMIT 10"""
    )


def _series(where: str = "", window: int = 28) -> str:
    return _m(
        f"""SELECT CAST(date AS VARCHAR) AS date, COUNT(*) AS messages,
          AVG(COUNT(*)) OVER (ORDER BY date ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) AS rolling_avg
        FROM messages WHERE date IS NOT NULL {where} GROUP BY date"""
    )


def _count(column: str, absent: str, where: str = "", limit: str = "") -> str:
    return _m(
        f"""SELECT {column}, COUNT(*) AS count FROM messages WHERE {absent} {where}
        GROUP BY {column} ORDER BY count DESC, {column} {limit}"""
    )


_DOW = """CASE dayofweek(date) WHEN 0 THEN 'Sunday' WHEN 1 THEN 'Monday' WHEN 2 THEN 'Tuesday'
  WHEN 3 THEN 'Wednesday' WHEN 4 THEN 'Thursday' WHEN 5 THEN 'Friday' WHEN 6 THEN 'Saturday' END"""


def _search(needle: str) -> str:
    return _m(
        f"""SELECT name, contact_info, COUNT(*) AS message_count FROM messages
        WHERE (contains(lower(COALESCE(name, '')), '{needle}') OR contains(lower(COALESCE(contact_info, '')), '{needle}'))
          AND (name IS NOT NULL OR contact_info IS NOT NULL)
        GROUP BY name, contact_info ORDER BY message_count DESC, name, contact_info LIMIT 20"""
    )


_PER_DAY = """(200 * COUNT(*) + (MAX(date) - MIN(date) + 1)) // (2 * (MAX(date) - MIN(date) + 1)) / 100.0"""
_STATS = f"""COUNT(*) AS total_messages, CAST(MIN(date) AS VARCHAR) AS first_date,
  CAST(MAX(date) AS VARCHAR) AS last_date, COUNT(DISTINCT date) AS active_days,
  CAST({_PER_DAY} AS DOUBLE) AS avg_per_day"""


def _compare(names: str) -> str:
    return _m(
        f""", mine AS (SELECT *, counterparty_name AS party FROM messages WHERE counterparty_name IN ({names})),
        dows AS (SELECT party, {_DOW} AS d, dayofweek(date) AS n, COUNT(*) AS c FROM mine
                 WHERE date IS NOT NULL GROUP BY ALL),
        hours AS (SELECT party, hour(moment) AS h, COUNT(*) AS c FROM mine WHERE date IS NOT NULL GROUP BY ALL)
        SELECT party AS name, {_STATS},
          COUNT(*) FILTER (chat_size = 1 AND is_from_me = 1) AS sent_direct,
          COUNT(*) FILTER (chat_size = 1 AND is_from_me = 0) AS received_direct,
          (SELECT d FROM dows WHERE dows.party = mine.party ORDER BY c DESC, n LIMIT 1) AS busiest_day,
          (SELECT h FROM hours WHERE hours.party = mine.party ORDER BY c DESC, h LIMIT 1) AS busiest_hour,
          COUNT(*) FILTER (reaction <> 'no-reaction') AS reactions,
          COUNT(*) FILTER (link_domain IS NOT NULL) AS links,
          COUNT(*) FILTER (is_audio_message = 1) AS audio_messages
        FROM mine GROUP BY party"""
    )


def _period(first: str, last: str) -> str:
    return f"""SELECT COUNT(*) AS messages, COUNT(*) FILTER (is_from_me = 1) AS sent,
        COUNT(*) FILTER (is_from_me = 0) AS received, COUNT(DISTINCT name) AS active_contacts,
        COUNT(DISTINCT date) AS active_days
        FROM messages WHERE date BETWEEN DATE '{first}' AND DATE '{last}'"""


_PHONE = r"(CASE WHEN {p} LIKE '+%' THEN '+' ELSE '' END) || regexp_replace({p}, '[^0-9]', '', 'g')"
_BOOK = f"""
people AS (
  SELECT c_custkey AS contact_id, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS digits, c_nationkey,
         regexp_extract(c_name, '^[^#]*') || ' ' || regexp_extract(c_name, '[^#]*$') AS name
  FROM customer WHERE c_mktsegment <> 'MACHINERY'),
listed AS (
  SELECT contact_id, CAST(0 AS BIGINT) AS place, name,
    '+1 (415) ' || digits[1:3] || '-' || digits[4:6] || '+' || digits[7:10] AS phone, NULL AS email FROM people
  UNION ALL SELECT contact_id, 1, name, ' +1-800-' || c_nationkey, NULL FROM people
  UNION ALL SELECT contact_id, 2, name, NULL, 'User_' || contact_id || '@Example.COM' FROM people),
entries AS (SELECT CASE WHEN phone IS NULL THEN lower(email) ELSE {_PHONE.format(p='phone')} END AS contact_key,
  name, contact_id, place FROM listed),
firsts AS (SELECT contact_key, name FROM (SELECT *, row_number() OVER (PARTITION BY contact_key
  ORDER BY contact_id, place) AS rn FROM entries) WHERE rn = 1)
"""
_OVERRIDES = f"""(SELECT {_KEY.format(u='c_custkey')} AS contact_key, 'VIP ' || c_name AS name
  FROM customer WHERE c_acctbal < 0)"""

MESSAGE_COLUMNS = """message_id, is_from_me, text, inferred_text, text_combined, body_text, handle_id, contact_info,
  updated_contact_info, chat_id, chat_members_handles, chat_members_contact_info, chat_size, is_audio_message,
  message_effect, reaction, is_thread_reply, link_domain, name, unix_ts AS timestamp, date, month, year"""

_FULL = _m(f"SELECT {MESSAGE_COLUMNS} FROM messages")


def _needs_reply(day: str) -> str:
    return _m(
        f"""SELECT chat_id, counterparty_name AS name, message_id, CAST(date AS VARCHAR) AS last_date,
          DATE '{day}' - date AS days_waiting
        FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY moment DESC, message_id DESC) AS rn
              FROM messages WHERE chat_size = 1 AND reaction = 'no-reaction' AND moment IS NOT NULL AND date <= '{day}')
        WHERE rn = 1 AND is_from_me = 0"""
    )


_WITH_BLANKS = """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ' ' || chr(9) || text || ' ' || chr(10) ELSE text END AS text
    FROM documents"""

ORACLE = {
    "raw_since_watermark": _raw(
        """SELECT message_id, CAST(raw_date AS BIGINT) AS date, text FROM message
        WHERE message_id > (SELECT MAX(message_id) // 2 FROM message)"""
    ),
    "high_watermark": _raw("SELECT MAX(message_id) AS watermark FROM message"),
    "message_chat_dedup": _raw("SELECT message_id, MIN(chat_id) AS chat_id FROM chat_message_join GROUP BY message_id"),
    "message_handle_join": _m("SELECT message_id, handle_id, contact_info, chat_id FROM messages"),
    "chat_members": _m(
        """SELECT chat_id, chat_size, CASE WHEN chat_size = 1 THEN only_member END AS only_member,
        chat_members_handles, chat_members_contact_info FROM members"""
    ),
    "address_book_entries": f"WITH {_BOOK} SELECT contact_key, name, contact_id, place FROM entries",
    "contact_keys_first": f"WITH {_BOOK} SELECT contact_key, name FROM firsts",
    "contact_conflicts": f"""WITH {_BOOK} SELECT e.contact_key, f.name AS kept, COUNT(DISTINCT e.name) AS names
        FROM entries e JOIN firsts f USING (contact_key) GROUP BY ALL HAVING COUNT(DISTINCT e.name) > 1""",
    "contact_map": f"""WITH {_BOOK} SELECT COALESCE(o.contact_key, f.contact_key) AS contact_key,
        COALESCE(o.name, f.name) AS name FROM firsts f FULL JOIN {_OVERRIDES} o ON o.contact_key = f.contact_key""",
    "contact_keys_normalized": f"""WITH {_BOOK} SELECT contact_id, place,
        COALESCE({_PHONE.format(p='phone')}, lower(email)) AS contact_key FROM listed""",
    "apple_timestamps": _m("SELECT message_id, unix_ts AS timestamp, date, month, year FROM messages"),
    "body_text": _m("SELECT message_id, text, inferred_text, text_combined, body_text FROM messages"),
    "body_text_documents": r"""SELECT doc_id, CASE WHEN t = '' OR starts_with(t, '__') OR ends_with(t, 'AttributeName')
        THEN NULL ELSE t END AS inferred_text FROM (SELECT doc_id,
        regexp_replace(regexp_replace(text, '^[\s\v\x{85}\p{Z}]+', ''), '[\s\v\x{85}\p{Z}]+$', '') AS t FROM documents)""",
    # Every byte that is not printable ASCII becomes a space: two to four per other character.
    "body_text_marked_documents": r"""SELECT doc_id, NULLIF(regexp_replace(trim(t, E' \n\t'),
        '^((\+2|iI|\+ |\+\n|\+!|\+\(|\+\*|\+<)[ \n\t]*)+', ''), '') AS inferred_text FROM (SELECT doc_id,
        regexp_replace(regexp_replace(regexp_replace(regexp_replace(split_part(text, 'NSDictionary', 1),
          '[\x{10000}-\x{10FFFF}]', '    ', 'g'), '[\x{800}-\x{FFFF}]', '   ', 'g'),
          '[\x{80}-\x{7FF}]', '  ', 'g'), '[^\x20-\x7E\n\t]', ' ', 'g') AS t FROM documents)""",
    "reaction_label": _m("SELECT reaction, COUNT(*) AS messages FROM messages GROUP BY reaction"),
    "effect_label": _m("SELECT message_effect, COUNT(*) AS messages FROM messages GROUP BY message_effect"),
    "link_domain": _m("SELECT message_id, link_domain FROM messages"),
    "link_domain_pages": "SELECT page_id, " + _DOMAIN.format(token=_TOKEN.format(t="url")) + " AS link_domain FROM pages",
    "flags": _m("SELECT message_id, is_from_me, is_audio_message, is_thread_reply FROM messages"),
    "recipient": _m("SELECT message_id, chat_size, updated_contact_info FROM messages"),
    "display_name": _m("SELECT message_id, contact_info, name, counterparty_name FROM messages"),
    "display_name_normalized": f"""WITH {_MESSAGES}, {_BOOK}
        SELECT message_id, COALESCE(f.name, contact_info) AS name FROM messages
        LEFT JOIN firsts f ON f.contact_key = lower(contact_info)""",
    "display_counterparty": _m("SELECT message_id, counterparty_name FROM messages"),
    "messages_full": _FULL,
    "conversation_messages": f"""WITH contacts AS (SELECT {_KEY.format(u='c_custkey')} AS contact_key, c_name
        FROM customer WHERE c_mktsegment <> 'MACHINERY'),
        turns AS (SELECT *, {_KEY.format(u='conv_id')} AS key, conv_id * 3600 + turn * 60 + 978307200 AS unix_ts,
          make_timestamp((conv_id * 3600 + turn * 60 + 978307200) * 1000000) AS moment,
          CASE WHEN role <> 'user' THEN NULLIF(regexp_replace(regexp_replace(text,
            '^[\\s\\v\\x{{85}}\\p{{Z}}]+', ''), '[\\s\\v\\x{{85}}\\p{{Z}}]+$', ''), '') END AS decoded FROM conversations)
        SELECT conv_id * 100000 + turn + 1 AS message_id, CAST(role = 'user' AS BIGINT) AS is_from_me,
          CASE WHEN role = 'user' THEN text END AS text, decoded AS inferred_text,
          CASE WHEN role = 'user' THEN text ELSE decoded END AS text_combined,
          CASE WHEN role = 'user' THEN text ELSE decoded END AS body_text,
          CASE WHEN role = 'user' THEN 0 ELSE conv_id + 1 END AS handle_id,
          CASE WHEN role <> 'user' THEN key END AS contact_info, key AS updated_contact_info, conv_id + 1 AS chat_id,
          '[' || (conv_id + 1) || ']' AS chat_members_handles, '["' || key || '"]' AS chat_members_contact_info,
          CAST(1 AS BIGINT) AS chat_size, CAST(0 AS BIGINT) AS is_audio_message, 'no-effect' AS message_effect, 'no-reaction' AS reaction,
          CAST(turn > 1 AS BIGINT) AS is_thread_reply, CAST(NULL AS VARCHAR) AS link_domain,
          CASE WHEN role <> 'user' THEN COALESCE(c_name, key) END AS name, unix_ts AS timestamp,
          CAST(moment AS DATE) AS date, month(moment) AS month, year(moment) AS year
        FROM turns LEFT JOIN contacts ON contact_key = key""",
    "top_contacts": _top(),
    "top_contacts_year": _top("AND year = 2024"),
    "top_contacts_direct": _top("AND chat_size = 1"),
    "top_contacts_sent": _top("AND is_from_me = 1"),
    "top_contacts_received": _top("AND is_from_me = 0"),
    "time_series": _series(),
    "time_series_contact": _series("AND name = 'Customer#000000017'", 7),
    "time_series_range": _series("AND date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' AND is_from_me = 1", 3),
    "time_series_year": _series("AND year = 2024"),
    "time_series_filled": _m(
        """, daily AS (SELECT date, COUNT(*) AS n FROM messages WHERE date IS NOT NULL GROUP BY date),
        days AS (SELECT CAST(unnest(generate_series(MIN(date), MAX(date), INTERVAL 1 DAY)) AS DATE) AS date FROM daily)
        SELECT CAST(days.date AS VARCHAR) AS date, COALESCE(n, 0) AS messages,
          AVG(COALESCE(n, 0)) OVER (ORDER BY days.date ROWS BETWEEN 27 PRECEDING AND CURRENT ROW) AS rolling_avg
        FROM days LEFT JOIN daily ON daily.date = days.date"""
    ),
    "time_series_display": _series() + " ORDER BY date LIMIT 200",
    "reactions": _count("reaction", "reaction <> 'no-reaction'"),
    "reactions_contact": _count(
        "reaction", "reaction <> 'no-reaction'", "AND name = 'Customer#000000017' AND year = 2024 AND is_from_me = 0"
    ),
    "effects": _count("message_effect", "message_effect <> 'no-effect'"),
    "effects_year": _count("message_effect", "message_effect <> 'no-effect'", "AND year = 2024"),
    "links": _count("link_domain", "link_domain IS NOT NULL", limit="LIMIT 20"),
    "seasonality_dow": _m(
        f"""SELECT dayofweek(date) AS dow_number, {_DOW} AS day_of_week, COUNT(*) AS messages
        FROM messages WHERE moment IS NOT NULL GROUP BY ALL"""
    ),
    "seasonality_dow_sent": _m(
        f"""SELECT dayofweek(date) AS dow_number, {_DOW} AS day_of_week, COUNT(*) AS messages
        FROM messages WHERE moment IS NOT NULL AND is_from_me = 1 GROUP BY ALL"""
    ),
    "seasonality_month": _m("SELECT month, COUNT(*) AS messages FROM messages WHERE month IS NOT NULL GROUP BY month"),
    "seasonality_split": _m(
        f"""SELECT dayofweek(date) AS dow_number, {_DOW} AS day_of_week, COUNT(*) FILTER (is_from_me = 1) AS sent,
        COUNT(*) FILTER (is_from_me = 0) AS received FROM messages WHERE moment IS NOT NULL GROUP BY ALL"""
    ),
    "seasonality_month_split": _m(
        """SELECT month, COUNT(*) FILTER (is_from_me = 1) AS sent, COUNT(*) FILTER (is_from_me = 0) AS received
        FROM messages WHERE month IS NOT NULL GROUP BY month"""
    ),
    "search_contacts": _search("r#00000001"),
    "search_contacts_literal": _search("_1"),
    "search_contacts_percent": _search("%"),
    "contact_stats": _m(
        f"SELECT name, {_STATS} FROM messages WHERE name IS NOT NULL GROUP BY name ORDER BY total_messages DESC, name LIMIT 50"
    ),
    "contact_stats_one": _m(f"SELECT name, {_STATS} FROM messages WHERE name = 'Customer#000000017' GROUP BY name"),
    "sql_passthrough": _m(
        """SELECT chat_id, COUNT(*) AS n, SUM(CASE WHEN is_audio_message = 1 THEN 1 ELSE 0 END)::BIGINT AS audio
        FROM messages WHERE chat_size >= 1 GROUP BY chat_id"""
    ),
    "group_message_count": _m("SELECT COUNT(*) AS group_messages FROM messages WHERE chat_size > 1"),
    "ingest_full": _FULL,
    "ingest_incremental": _FULL,
    "ingest_idempotent": _FULL,
    "ingest_stream": _FULL,
    "ingest_runs": _m(
        """, whole AS (SELECT MAX(message_id) AS high, COUNT(*) AS n FROM messages),
        half AS (SELECT MAX(message_id) AS high, COUNT(*) AS n FROM messages
          WHERE message_id <= (SELECT high // 2 FROM whole)),
        runs AS (
          SELECT 'full' AS mode, CAST(0 AS BIGINT) AS since, high AS last_message_id, n AS rows_written, n AS total_messages
          FROM half
          UNION ALL SELECT 'incremental', half.high, whole.high, whole.n - half.n, whole.n FROM whole, half
          UNION ALL SELECT 'incremental', high, high, 0, n FROM whole)
        SELECT *, (SELECT COUNT(*) FROM contacts) AS contacts_resolved FROM runs"""
    ),
    "status": _m(
        """SELECT COUNT(*) AS total_messages, format('{:,}', COUNT(*)) AS messages_text,
        MAX(message_id) AS last_message_id, CAST(2 AS BIGINT) AS schema_version,
        (SELECT COUNT(*) FROM contacts) AS contacts_resolved, CAST(NULL AS VARCHAR) AS warning FROM messages"""
    ),
    "result_json": _m(
        """SELECT CAST(to_json({'name': name, 'message_count': n}) AS VARCHAR) AS json FROM (
        SELECT name, COUNT(*) AS n FROM messages WHERE name IS NOT NULL GROUP BY name ORDER BY n DESC, name LIMIT 100)"""
    ),
    "result_json_text": _m(
        """SELECT CAST(to_json({'message_id': CAST(message_id AS VARCHAR), 'body_text': COALESCE(body_text, ''),
          'timestamp': COALESCE(strftime(moment, '%Y-%m-%dT%H:%M:%SZ'), ''), 'date': COALESCE(CAST(date AS VARCHAR), '')})
          AS VARCHAR) AS json FROM messages"""
    ),
    "result_csv_roundtrip": _m("SELECT message_id, name, body_text, chat_members_contact_info FROM messages"),
    "contact_deep_dive": _compare("'Customer#000000017'"),
    "compare_contacts": _compare("'Customer#000000017', 'Customer#000000093', 'group-chat'"),
    "needs_reply": _needs_reply("2024-02-01"),
    "needs_reply_past": _needs_reply("2024-01-15"),
    "needs_reply_stored": _needs_reply("2024-02-01"),
    "documents_csv_roundtrip": _WITH_BLANKS,
    "documents_json_lines": _WITH_BLANKS,
    "period_in_review": _m(
        ", p AS (" + _period("2024-01-08", "2024-01-14") + ") SELECT '2024-01-08 to 2024-01-14' AS period, * FROM p"
    ),
    "group_chats": _m(
        """SELECT chat_id, COUNT(*) AS messages, MAX(chat_size) AS participants,
          COUNT(DISTINCT handle_id) FILTER (is_from_me = 0) AS senders,
          CAST(MIN(date) AS VARCHAR) AS first_date, CAST(MAX(date) AS VARCHAR) AS last_date
        FROM messages WHERE chat_size > 1 GROUP BY chat_id"""
    ),
    "compare_periods": _m(
        ", a AS (" + _period("2024-01-08", "2024-01-14") + "), b AS (" + _period("2024-01-12", "2024-01-21")
        + """), sides AS (
        UNPIVOT a ON messages, sent, received, active_contacts, active_days INTO NAME metric VALUE first_period),
        others AS (
        UNPIVOT b ON messages, sent, received, active_contacts, active_days INTO NAME metric VALUE second_period)
        SELECT metric, first_period, second_period, second_period - first_period AS change,
          (second_period - first_period) * 100.0::DOUBLE / first_period AS change_percent
        FROM sides JOIN others USING (metric)"""
    ),
}

ORACLE |= {
    "contact_deep_dive_stored": ORACLE["contact_deep_dive"],
    "raw_files_csv": ORACLE["messages_full"],
    "raw_files_json": ORACLE["messages_full"],
    "contact_overrides_file": ORACLE["contact_map"],
    "ingest_forced": ORACLE["ingest_idempotent"],
    "ingest_stream_late_links": _FULL,
    "ingest_compacted": _FULL,
    "ingest_migrated": _FULL,
    "messages_of_days": _m(
        """SELECT message_id, date, body_text, name FROM messages
        WHERE date BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'"""
    ),
    "data_files": _m(
        """SELECT COUNT(*) AS messages, MIN(message_id) AS first_id, MAX(message_id) AS last_id,
        CAST(MIN(date) AS VARCHAR) AS first_date, CAST(MAX(date) AS VARCHAR) AS last_date, CAST(0 AS BIGINT) AS overlapping
        FROM messages"""
    ),
    "schema_gate": _m(
        """, h AS (SELECT MAX(message_id) // 2 AS half FROM messages)
        SELECT COUNT(*) AS rows, CAST(2 AS BIGINT) AS schema_version, '' AS missing_columns, '' AS extra_columns,
          '' AS other_types, true AS accepted FROM messages, h GROUP BY message_id <= half"""
    ),
}

ORACLE |= {
    "high_watermark_files": ORACLE["high_watermark"],
    "compare_contacts_stored": ORACLE["compare_contacts"],
    "top_contacts_daily": _m(
        """SELECT name, COUNT(*) AS message_count FROM messages WHERE name IS NOT NULL AND year = 2024 AND chat_size = 1
        AND is_from_me = 0 GROUP BY name ORDER BY message_count DESC, name LIMIT 30"""
    ),
    "time_series_daily": ORACLE["time_series"],
    "reactions_daily": ORACLE["reactions"],
    "effects_daily": ORACLE["effects_year"],
    "links_daily": ORACLE["links"],
    "seasonality_dow_daily": ORACLE["seasonality_split"],
    "seasonality_month_daily": ORACLE["seasonality_month"],
    "search_contacts_daily": ORACLE["search_contacts"],
    "search_contacts_index": ORACLE["search_contacts"],
    "search_contacts_index_short": ORACLE["search_contacts_literal"],
    "contact_stats_daily": ORACLE["contact_stats"],
    "group_message_count_daily": ORACLE["group_message_count"],
}

# Messages made of orders, a few years later.
_ORDERS = f"""WITH m AS (SELECT CAST(o_orderdate AS DATE) + 3653 AS date, o_orderkey % 5 = 0 AS sent,
    coalesce(c.name, k) AS name FROM (SELECT *, {_KEY.format(u='o_custkey')} AS k FROM orders) LEFT JOIN
    (SELECT {_KEY.format(u='c_custkey')} AS k, c_name AS name FROM customer WHERE c_mktsegment <> 'MACHINERY') c USING (k)),
  d AS (SELECT date, COUNT(*) AS messages FROM m GROUP BY date)
"""
_MEAN = "AVG(messages) OVER (ORDER BY date ROWS BETWEEN 27 PRECEDING AND CURRENT ROW) AS rolling_avg"

ORACLE |= {
    "seasonality_month_years": _ORDERS + "SELECT month(date) AS month, COUNT(*) AS messages FROM m GROUP BY ALL",
    "seasonality_month_years_split": _ORDERS
    + "SELECT month(date) AS month, COUNT(*) FILTER (sent) AS sent, COUNT(*) FILTER (NOT sent) AS received FROM m GROUP BY ALL",
    "seasonality_dow_years": _ORDERS
    + f"SELECT dayofweek(date) AS dow_number, {_DOW} AS day_of_week, COUNT(*) AS messages FROM m WHERE NOT sent GROUP BY ALL",
    "time_series_years": _ORDERS
    + f"""SELECT CAST(date AS VARCHAR) AS date, messages, {_MEAN} FROM (SELECT CAST(x.date AS DATE) AS date, coalesce(messages, 0) AS messages
        FROM (SELECT unnest(generate_series(MIN(date), MAX(date), INTERVAL 1 DAY)) AS date FROM d) x
        LEFT JOIN d ON d.date = CAST(x.date AS DATE))""",
    "time_series_display_years": _ORDERS
    + f"SELECT CAST(date AS VARCHAR) AS date, messages, {_MEAN} FROM d ORDER BY d.date LIMIT 200",
    "top_contacts_years": _ORDERS
    + "SELECT name, COUNT(*) AS message_count FROM m WHERE year(date) = 2005 GROUP BY name ORDER BY message_count DESC, name LIMIT 50",
}
