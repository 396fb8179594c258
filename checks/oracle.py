"""DuckDB statements for the registered queries.

Expected mail columns are rebuilt straight from ``documents``; no statement parses a
message. ``sql("a", "b", body)`` puts the named building blocks (and what those need)
in front of ``body``.
"""

from __future__ import annotations

from mailrank.functions.text import MID_BOTH, MID_LETTER, MID_NUMBER

ORACLE = {}


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


_BOTH, _LETTER, _NUMBER = (c.replace("'", "''") for c in (MID_BOTH, MID_LETTER, MID_NUMBER))
_WORD = (
    rf"(?:\p{{L}}[\p{{L}}\p{{M}}]*(?:[{_BOTH}{_LETTER}]\p{{L}}[\p{{L}}\p{{M}}]*)*"
    rf"|\p{{N}}[\p{{N}}\p{{M}}]*(?:[{_BOTH}{_NUMBER}]\p{{N}}[\p{{N}}\p{{M}}]*)*|\p{{Pc}}\p{{M}}*)+"
)


def words(c: str) -> str:
    return rf"regexp_extract_all(lower(regexp_replace({c}, '([\p{{Han}}\p{{Hiragana}}])', ' \1 ', 'g')), '{_WORD}')"


def digits(c: str) -> str:
    return f"regexp_replace({c}, '[^0-9]', '', 'g')"


def phone(c: str) -> str:
    return f"CASE WHEN length({digits(c)}) BETWEEN 7 AND 15 THEN {digits(c)} ELSE '' END"


def hashed(source: str, key: str, c: str) -> str:
    """``(key, v)``: 768 elements from the SHA-256 bytes of a text, scaled to unit length."""
    digit = "(strpos('0123456789abcdef', substr(h, (i * 2 + {o})::BIGINT, 1)) - 1)"
    byte = f"({digit.format(o=1)} * 16 + {digit.format(o=2)})"
    return f"""SELECT {key}, flatten(list_transform(range(24), lambda j: u)) AS v FROM (
        SELECT {key}, list_transform(b, lambda x: (x / n)::FLOAT) AS u FROM (
        SELECT {key}, b, sqrt(list_sum(list_transform(b, lambda x: x * x * 24))) AS n FROM (
        SELECT {key}, list_transform(range(32), lambda i: {byte}::DOUBLE / 255 * 2 - 1) AS b FROM (
        SELECT {key}, sha256({c}) AS h FROM {source}))))"""


def cut(c: str, n: int = 200) -> str:
    return f"CASE WHEN length({c}) > {n} THEN substr({c}, 1, {n}) || '...' ELSE {c} END"


def rank(score: str, digits: int | None = 9) -> str:
    value = f"round({score}, {digits})" if digits else score
    return f"row_number() OVER (PARTITION BY qid ORDER BY {value} DESC, doc_id)"


BLOCKS = {
    "mails": (
        (),
        f"""SELECT doc_id, '<' || doc_id || '@' || source || '.example.com>' AS message_id,
            CASE WHEN doc_id % 7 = 0 THEN 'User' ELSE 'user' END || doc_id % 50 || '@example.com' AS from_email,
            'Name ' || doc_id % 50 AS from_name,
            CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'a' || doc_id % 5 || '@example.com' END
              || CASE WHEN doc_id % 3 = 0 THEN ', c' || doc_id % 4 || '@example.com' ELSE '' END
              || CASE WHEN doc_id % 9 = 0 THEN ', b@example.com' ELSE '' END AS all_recipients,
            'Note ' || doc_id || CASE WHEN doc_id % 4 = 0 THEN ' part two' ELSE '' END AS subject,
            {strip('text')} AS body_content,
            989858340000 + (doc_id % 5000000) * 60000 AS timestamp_ms,
            doc_id % 10 = 0 AS has_attachments,
            source || '/' || doc_id || '.' AS labels
          FROM documents""",
    ),
    "messages": (
        (),
        """SELECT doc_id, source || '/' || doc_id || '.' AS file,
            'Message-ID: <' || doc_id || '@' || source || '.example.com>' || chr(10) ||
            'Date: ' || strftime(TIMESTAMP '2001-05-14 16:39:00' + to_minutes(doc_id % 5000000), '%a, %-d %b %Y %H:%M:%S') || ' +0000 (UTC)' || chr(10) ||
            CASE WHEN doc_id % 7 = 0 THEN 'From: User' ELSE 'From: user' END || doc_id % 50 || '@example.com' || chr(10) ||
            CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'To: a' || doc_id % 5 || '@example.com' || chr(10) END ||
            CASE WHEN doc_id % 3 = 0 THEN 'Cc: c' || doc_id % 4 || '@example.com' || chr(10) ELSE '' END ||
            CASE WHEN doc_id % 9 = 0 THEN 'Bcc: b@example.com' || chr(10) ELSE '' END ||
            'Subject: Note ' || doc_id || CASE WHEN doc_id % 4 = 0 THEN chr(10) || ' part two' ELSE '' END || chr(10) ||
            'X-From: Name ' || doc_id % 50 || ' <u>' || chr(10) ||
            CASE WHEN doc_id % 10 = 0 THEN 'Content-Type: Multipart/mixed' ELSE 'Content-Type: text/plain' END AS head,
            text
          FROM documents""",
    ),
    "turns": (
        (),
        f"""SELECT conv_id || '/' || turn AS file, conv_id, turn, role,
            array_to_string(list_transform(string_split(text, chr(10)), lambda x: {strip('x')}), ' ') AS folded
          FROM conversations""",
    ),
    "tokens": (
        ("mails",),
        f"""SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos
          FROM (SELECT doc_id, {words('body_content')} AS t FROM mails)""",
    ),
    "posted": (
        ("tokens",),
        """SELECT term, doc_id, count(*) AS tf, any_value(dl) AS dl FROM
            (SELECT term, doc_id, count(*) OVER (PARTITION BY doc_id) AS dl FROM tokens) GROUP BY term, doc_id""",
    ),
    "corpus": (
        ("tokens",),
        "SELECT count(DISTINCT doc_id) AS n_docs, count(*)::DOUBLE / count(DISTINCT doc_id) AS avgdl FROM tokens",
    ),
    "dfs": (("posted",), "SELECT term, count(*) AS df FROM posted GROUP BY term"),
    "exact": (
        ("mails",),
        f"""SELECT 'sender_email' AS field, from_email AS term, doc_id FROM mails
          UNION ALL SELECT 'phone_num', p, doc_id FROM (SELECT doc_id, {phone('body_content')} AS p FROM mails) WHERE p <> ''""",
    ),
    "raw_searches": (
        (),
        """SELECT item_id AS qid, CASE WHEN item_id % 7 = 3 THEN '-' ELSE text END AS query_text,
            CASE item_id % 4 WHEN 0 THEN ' User' || item_id % 50 || '@Example.com ' WHEN 1 THEN text WHEN 2 THEN '-'
              ELSE 'call 713-853-' || lpad(item_id::VARCHAR, 4, '0') END AS target,
            CASE WHEN item_id % 5 = 0 THEN 0 ELSE 20 END AS max_results
          FROM benchmark""",
    ),
    "searches": (
        ("raw_searches",),
        """SELECT qid, CASE WHEN query_text = '-' THEN '' ELSE query_text END AS query_text,
            CASE WHEN target = '-' THEN '' ELSE target END AS target,
            (CASE WHEN max_results > 0 THEN max_results ELSE 100 END)::INTEGER AS max_results
          FROM raw_searches""",
    ),
    "wanted": (
        ("searches",),
        f"""SELECT qid, field, term, count(*) AS n FROM (
            SELECT qid, 'sender_email' AS field, {strip('lower(target)')} AS term FROM searches
            UNION ALL SELECT qid, 'phone_num', {phone('target')} FROM searches
            UNION ALL SELECT qid, 'body_text', unnest({words('target')}) FROM searches)
          WHERE term <> '' GROUP BY ALL""",
    ),
    "text_wanted": (
        (),
        f"""SELECT qid, term, count(*) AS n FROM (SELECT item_id AS qid, unnest({words('text')}) AS term FROM benchmark) GROUP BY ALL""",
    ),
    "asked_words": (
        ("text_wanted",),
        "SELECT qid, arg_min(term, md5(qid || term)) AS word FROM text_wanted WHERE regexp_full_match(term, '[a-z]{5,}') GROUP BY qid",
    ),
    "text_scores": (
        ("posted", "dfs", "corpus", "text_wanted"),
        """SELECT w.qid, p.doc_id, sum(w.n * ln(1 + (c.n_docs - d.df + 0.5) / (d.df + 0.5))
              * p.tf / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / c.avgdl))) AS score
           FROM posted p JOIN text_wanted w USING (term) JOIN dfs d USING (term) CROSS JOIN corpus c GROUP BY ALL""",
    ),
    "pattern_docs": (
        ("posted", "dfs", "asked_words"),
        """SELECT DISTINCT qid, doc_id, 1.0::DOUBLE AS score FROM (SELECT qid, term FROM asked_words, dfs WHERE CASE qid % 3
              WHEN 0 THEN starts_with(term, word[1:3])
              WHEN 1 THEN regexp_full_match(term, word[1] || '.' || word[3] || '.*' || word[-1])
              ELSE regexp_full_match(term, word[1:2] || '[a-m]{2,}') END) JOIN posted USING (term)""",
    ),
    "misspelt": (("asked_words",), "SELECT qid, word[1:2] || word[4] || word[3] || word[5:] AS word FROM asked_words"),
    # DuckDB counts edits in bytes. The asked words are plain letters, so any other letter of a
    # word differs from all of theirs, and one byte may stand for it.
    "letters": (("dfs",), "SELECT term, regexp_replace(term, '[^\\x00-\\x7F]', '~', 'g') AS letters FROM dfs"),
    "fuzzy_docs": (
        ("posted", "letters", "misspelt"),
        """SELECT qid, doc_id, max(round(greatest(1 - edits / least(length(word), length(term)), 0), 8)) AS score FROM
              (SELECT qid, word, term, levenshtein(word, letters) AS edits FROM misspelt, letters
               WHERE levenshtein(word, letters) <= qid % 2 + 1) JOIN posted USING (term) GROUP BY ALL""",
    ),
    "exact_part": (
        ("exact", "wanted"),
        """SELECT w.qid, e.doc_id, ln(1 + (f.n_docs - d.df + 0.5) / (d.df + 0.5)) / 2.2 AS score
          FROM exact e JOIN wanted w USING (field, term)
          JOIN (SELECT field, term, count(*) AS df FROM exact GROUP BY ALL) d USING (field, term)
          JOIN (SELECT field, count(*) AS n_docs FROM exact GROUP BY ALL) f USING (field)""",
    ),
    "body_part": (
        ("posted", "dfs", "corpus", "wanted"),
        """SELECT w.qid, p.doc_id, sum(w.n * ln(1 + (c.n_docs - d.df + 0.5) / (d.df + 0.5))
              * p.tf / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / c.avgdl))) AS score
          FROM posted p JOIN wanted w ON w.field = 'body_text' AND w.term = p.term
          JOIN dfs d ON d.term = p.term CROSS JOIN corpus c GROUP BY ALL""",
    ),
    "keyword": (
        ("exact_part", "body_part"),
        f"""SELECT qid, doc_id, rank, score FROM (
            SELECT qid, doc_id, score, {rank('score')} AS rank FROM (
              SELECT qid, doc_id, sum(score) AS score FROM
                (SELECT * FROM exact_part UNION ALL SELECT * FROM body_part) GROUP BY ALL))
          JOIN searches USING (qid) WHERE rank <= max_results""",
    ),
    "hashed_docs": (
        ("mails",),
        hashed("mails", "doc_id", "'document: ' || substr(subject || ' ' || body_content, 1, 512)"),
    ),
    "hashed_queries": (
        ("searches",),
        hashed("(SELECT * FROM searches WHERE query_text <> '')", "qid", "'query: ' || query_text"),
    ),
    "semantic": (
        ("hashed_docs", "hashed_queries"),
        f"""SELECT qid, doc_id, rank FROM (
            SELECT qid, doc_id, {rank('score')} AS rank FROM (
              SELECT qid, doc_id, list_cosine_similarity(d.v::DOUBLE[], q.v::DOUBLE[]) AS score FROM hashed_docs d CROSS JOIN hashed_queries q))
          JOIN searches USING (qid) WHERE rank <= max_results""",
    ),
    "vecs": ((), "SELECT vec_id AS doc_id, embedding::DOUBLE[] AS vec, label FROM embeddings"),
    "centers": (
        ("vecs",),
        """SELECT label AS qid, list(m ORDER BY pos) AS v FROM (SELECT label, pos, avg(x) AS m FROM
            (SELECT label, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM vecs) GROUP BY ALL) GROUP BY label""",
    ),
    "near": (
        ("vecs", "centers"),
        f"""SELECT qid, doc_id, score, rank FROM (SELECT *, {rank('score')} AS rank FROM (
            SELECT qid, doc_id, round(list_cosine_similarity(vec, v), 9) AS score FROM vecs CROSS JOIN centers)) WHERE rank <= 20""",
    ),
    "span": ((), "SELECT min(list_min(embedding))::DOUBLE AS lo, max(list_max(embedding))::DOUBLE AS hi FROM embeddings"),
    "codes": (
        ("vecs", "span"),
        """SELECT doc_id, vec, lo, hi,
            list_transform(vec, lambda x: floor((x - lo) * (127 / (hi - lo)) + 0.5)::TINYINT) AS codes,
            list_transform(vec, lambda x: lo + floor((x - lo) * (127 / (hi - lo)) + 0.5) * ((hi - lo) / 127)) AS back
          FROM vecs CROSS JOIN span""",
    ),
    "near_codes": (
        ("codes", "centers"),
        f"""SELECT *, {rank('score')} AS rank FROM (
            SELECT qid, doc_id, round(list_cosine_similarity(back, v), 9) AS score,
              round(list_cosine_similarity(vec, v), 9) AS full_score FROM codes CROSS JOIN centers)""",
    ),
    "spikes": (
        ("vecs",),
        f"""SELECT qid, doc_id, rank FROM (SELECT qid, doc_id, {rank('score')} AS rank FROM
            (SELECT label AS qid, doc_id, list_max(vec) AS score FROM vecs)) WHERE rank <= 20""",
    ),
    "fused": (
        ("near", "spikes"),
        """SELECT qid, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf_score,
            max(rank) FILTER (leg = 's') AS semantic_rank, max(rank) FILTER (leg = 'k') AS keyword_rank
          FROM (SELECT qid, doc_id, rank, 's' AS leg FROM near UNION ALL SELECT qid, doc_id, rank, 'k' FROM spikes) GROUP BY ALL""",
    ),
    "fused_top": (
        ("fused",),
        f"SELECT * FROM (SELECT *, {rank('rrf_score', None)} AS rank FROM fused) WHERE rank <= 20",
    ),
    "legs": (
        ("semantic", "keyword"),
        """SELECT qid, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf_score,
            max(rank) FILTER (leg = 's') AS semantic_rank, max(rank) FILTER (leg = 'k') AS keyword_rank
          FROM (SELECT qid, doc_id, rank, 's' AS leg FROM semantic UNION ALL SELECT qid, doc_id, rank, 'k' FROM keyword) GROUP BY ALL""",
    ),
    "hits": (
        ("legs", "searches", "mails"),
        f"""SELECT qid, rank::INTEGER AS rank, doc_id, message_id, from_email, from_name, all_recipients, subject,
            {cut('body_content')} AS body_snippet, body_content, timestamp_ms, has_attachments, labels,
            round(rrf_score, 6) AS rrf_score, semantic_rank::INTEGER AS semantic_rank, keyword_rank::INTEGER AS keyword_rank
          FROM (SELECT *, {rank('rrf_score', None)} AS rank FROM legs) JOIN searches USING (qid) JOIN mails USING (doc_id)
          WHERE rank <= max_results""",
    ),
    "word_vocab": (
        ("spaced",),
        """SELECT token, id FROM (SELECT token, min(doc_id * 1000000 + pos) + 10 AS id, min(doc_id) AS lo, max(doc_id) AS hi
            FROM spaced WHERE token <> '' GROUP BY token) WHERE lo < hi""",
    ),
    "spaced": (
        (),
        rf"""SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos
          FROM (SELECT doc_id, regexp_split_to_array({strip('lower(text)')}, '[ \t\n\x0b\f\r]+') AS w FROM documents)""",
    ),
    "ids": (
        ("spaced", "word_vocab"),
        """SELECT doc_id, 0 AS pos, 2 AS id FROM documents
          UNION ALL SELECT doc_id, pos + 1, coalesce(id, 1) FROM spaced LEFT JOIN word_vocab USING (token) WHERE token <> ''
          UNION ALL SELECT doc_id, coalesce(n, 0) + 1, 3 FROM documents LEFT JOIN
            (SELECT doc_id, count(*) AS n FROM spaced WHERE token <> '' GROUP BY doc_id) USING (doc_id)""",
    ),
    "phrase_words": (
        (),
        f"""SELECT qid, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS place FROM
            (SELECT item_id AS qid, {words('text')} AS t FROM benchmark)""",
    ),
    "few_words": (
        (),
        """SELECT * FROM (VALUES (1, 'the', 0), (1, 'of', 1), (1, 'and', 2), (2, 'de', 0), (2, 'la', 1), (3, 'und', 0), (3, 'der', 1)) AS t(qid, term, place)""",
    ),
    "double_words": (
        (),
        """SELECT * FROM (VALUES (1, 'the', 0), (1, 'the', 1), (2, 'de', 0), (2, 'la', 1), (2, 'de', 2),
            (3, 'und', 0), (3, 'die', 1), (3, 'und', 2)) AS t(qid, term, place)""",
    ),
}


def sql(*parts: str) -> str:
    *names, body = parts
    order: list[str] = []

    def need(name):
        for other in BLOCKS[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    # Shared blocks are computed once.
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({BLOCKS[n][1]})" for n in order) + "\n" + body if order else body


def elements(source: str, key: str, column: str, digits: int | None) -> str:
    """One row per vector element."""
    value = f"round(value::DOUBLE, {digits})" if digits else "value"
    return f"""SELECT {key}, pos::INTEGER AS pos, {value} AS value FROM (
        SELECT {key}, unnest({column}) AS value, generate_subscripts({column}, 1) - 1 AS pos FROM {source})"""


MAIL_COLUMNS = "message_id, from_email, from_name, all_recipients, subject, body_content, timestamp_ms, has_attachments, labels"
ORACLE.update(
    mail_csv_read=sql(
        "messages",
        "SELECT file, md5(head || chr(10) || chr(10) || text) AS message_md5, length(head || chr(10) || chr(10) || text)::INTEGER AS n_chars FROM messages",
    ),
    mail_csv_two_headers=sql("messages", "SELECT file, md5(head || chr(10) || chr(10) || text) AS message_md5 FROM messages"),
    row_cap=sql("mails", "SELECT doc_id, message_id FROM mails ORDER BY doc_id LIMIT 100"),
    emails_append=sql("mails", "SELECT message_id, labels, 2::BIGINT AS n_copies FROM mails"),
    emails_row_id=sql("mails", "SELECT row_number() OVER (ORDER BY doc_id) AS id, message_id FROM mails"),
    emails_scan=sql("mails", f"SELECT {MAIL_COLUMNS} FROM mails"),
    emails_count="SELECT count(*) AS n_rows FROM documents",
    emails_sample=sql(
        "mails",
        "SELECT doc_id, message_id, from_email, subject, length(body_content)::INTEGER AS body_length FROM mails ORDER BY doc_id LIMIT 3",
    ),
    search_tables_build=sql(
        "posted", "dfs", "exact",
        """SELECT 'docs' AS name, count(*) AS n_rows FROM mails UNION ALL SELECT 'vectors', count(*) FROM mails
           UNION ALL SELECT 'exact_terms', count(*) FROM exact UNION ALL SELECT 'postings', count(*) FROM posted
           UNION ALL SELECT 'term_stats', count(*) FROM dfs UNION ALL SELECT 'corpus_stats', 1""",
    ),
    hit_report=sql(
        "hits",
        f"""SELECT qid, rank, 'Result #' || rank || chr(10) || repeat('-', 40) || chr(10) ||
              'From: ' || from_name || ' <' || from_email || '>' || chr(10) || 'To: ' || all_recipients || chr(10) ||
              'Subject: ' || subject || chr(10) ||
              'Date: ' || strftime(make_timestamp(timestamp_ms * 1000), '%a %b %d %H:%M:%S UTC %Y') || chr(10) ||
              'Has attachments: ' || has_attachments::VARCHAR || chr(10) || 'Labels: ' || labels || chr(10) || chr(10) ||
              'Snippet:' || chr(10) || body_snippet AS block FROM hits
            UNION ALL SELECT qid, 0, 'No results found.' FROM searches WHERE qid NOT IN (SELECT qid FROM hits)""",
    ),
    hit_dates="""SELECT doc_id, strftime(make_timestamp((doc_id % 300000 * 100003 + CASE doc_id % 4 WHEN 0 THEN -62135596800000
        WHEN 1 THEN -2240524800000 WHEN 2 THEN 2335219200000 ELSE 253370764800000 END) * 1000), '%a %b %d %H:%M:%S UTC %Y') AS date FROM documents""",
    parse_empty_message=sql(
        "mails",
        "SELECT "
        + ", ".join(
            f"CASE WHEN doc_id % 5 < 2 THEN {blank} ELSE {c} END AS {c}"
            for c, blank in [(c.strip(), "''") for c in MAIL_COLUMNS.split(",") if c.strip() not in ("timestamp_ms", "has_attachments", "labels")]
            + [("timestamp_ms", "0"), ("has_attachments", "false")]
        )
        + ", labels FROM mails",
    ),
    mail_line_count=r"""SELECT doc_id, (CASE WHEN t = '' AND text <> '' THEN 0 ELSE len(string_split(t, chr(10))) END)::INTEGER AS n_lines
        FROM (SELECT doc_id, text, rtrim(text, chr(10)) AS t FROM documents)""",
    parse_header_body=sql(
        "messages", f"SELECT file, chr(10) || head AS header_text, {strip('text')} AS body FROM messages"
    ),
    parse_headers_long=sql(
        "mails",
        """SELECT file, row_number() OVER (PARTITION BY file ORDER BY o)::INTEGER AS pos, k, v FROM (
            SELECT labels AS file, 1 AS o, 'message-id' AS k, message_id AS v FROM mails
            UNION ALL SELECT labels, 2, 'date', strftime(make_timestamp(timestamp_ms * 1000), '%a, %-d %b %Y %H:%M:%S') || ' +0000 (UTC)' FROM mails
            UNION ALL SELECT labels, 3, 'from', from_email FROM mails
            UNION ALL SELECT labels, 4, 'to', 'a' || doc_id % 5 || '@example.com' FROM mails WHERE doc_id % 11 > 0
            UNION ALL SELECT labels, 5, 'cc', 'c' || doc_id % 4 || '@example.com' FROM mails WHERE doc_id % 3 = 0
            UNION ALL SELECT labels, 6, 'bcc', 'b@example.com' FROM mails WHERE doc_id % 9 = 0
            UNION ALL SELECT labels, 7, 'subject', subject FROM mails
            UNION ALL SELECT labels, 8, 'x-from', from_name || ' <u>' FROM mails
            UNION ALL SELECT labels, 9, 'content-type', CASE WHEN has_attachments THEN 'Multipart/mixed' ELSE 'text/plain' END FROM mails)""",
    ),
    parse_folded_headers=sql(
        "turns",
        """SELECT file, 1 AS pos, 'conv' AS k, conv_id::VARCHAR AS v FROM turns UNION ALL SELECT file, 2, 'text', folded FROM turns
           UNION ALL SELECT file, 3, 'role', 'first' FROM turns UNION ALL SELECT file, 4, 'role', role FROM turns""",
    ),
    header_last_wins=sql("turns", "SELECT file, role, '' AS none FROM turns"),
    parse_messages_core=sql("mails", f"SELECT doc_id, {MAIL_COLUMNS} FROM mails"),
    sender_name=f"""SELECT page_id, {strip("string_split(chr(9) || ' ' || url || ' ' || html, '<')[1]")} AS from_name,
        {strip("string_split(url, '<')[1]")} AS bare_name FROM pages""",
    all_recipients=sql("mails", "SELECT doc_id, all_recipients FROM mails"),
    mail_date_parse="""SELECT o_orderkey,
        CASE WHEN k = 0 OR k = 4 OR (k = 3 AND isodow(d) = 1) THEN ms ELSE -1 END AS timestamp_ms,
        CASE WHEN k = 0 OR k >= 3 THEN ms ELSE -1 END AS any_weekday_ms
        FROM (SELECT o_orderkey, o_orderkey % 5 AS k, o_orderdate AS d,
          (epoch_ms(o_orderdate::DATE::TIMESTAMP) + ((10 * 60 + 20) * 60 + 30) * 1000 + (7 * 60 + 30) * 60000)::BIGINT AS ms FROM orders)""",
    attachment_flag=sql("mails", "SELECT has_attachments, count(*) AS n_mails FROM mails GROUP BY ALL"),
    body_normalise=sql("mails", "SELECT doc_id, body_content FROM mails"),
    clean_snippet=rf"""SELECT doc_id, {cut('t')} AS snippet FROM
        (SELECT doc_id, {strip(r"regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g')")} AS t FROM documents)""",
    phone_digits=f"SELECT doc_id, {phone('text')} AS phone FROM documents",
    text_to_embed=sql("mails", "SELECT doc_id, substr(subject || ' ' || body_content, 1, 512) AS embed_text FROM mails"),
    role_prefix="SELECT item_id, 'document: ' || text AS as_document, 'query: ' || text AS as_query FROM benchmark",
    stored_fields=sql(
        "mails",
        """SELECT doc_id, message_id, from_email, from_name, all_recipients, CASE WHEN doc_id % 6 > 0 THEN subject ELSE '' END AS subject,
            body_content, timestamp_ms, has_attachments::INTEGER AS has_attachments, labels FROM mails""",
    ),
    exact_term_key=sql("mails", "SELECT doc_id, from_email, lower(from_email) AS lookup_key FROM mails"),
    flag_roundtrip=sql("mails", "SELECT doc_id, has_attachments::INTEGER AS stored, has_attachments AS read_back FROM mails"),
    safe_millis=sql(
        "mails",
        "SELECT doc_id, CASE doc_id % 4 WHEN 2 THEN -5 WHEN 3 THEN timestamp_ms ELSE 0 END::BIGINT AS millis FROM mails",
    ),
    query_normalise=sql("searches", "SELECT * FROM searches"),
    hit_snippet=f"SELECT doc_id, {cut('text')} AS snippet FROM documents",
    hash_embedding=elements(f"({hashed('documents', 'doc_id', 'text')})", "doc_id", "v", 5),
    l2_normalise=sql(
        "vecs",
        "SELECT doc_id, pos::INTEGER AS pos, round((CASE WHEN n < 1e-12 THEN x ELSE x / n END)::FLOAT::DOUBLE, 5) AS value FROM "
        "(SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) - 1 AS pos, sqrt(list_sum(list_transform(s, lambda y: y * y))) AS n "
        "FROM (SELECT doc_id, list_transform(vec, lambda x: x * (doc_id % 5)) AS s FROM vecs))",
    ),
    blank_zero_vector="SELECT doc_id, 768 AS dim, doc_id % 3 = 0 AS all_zero FROM documents",
    vocab_load="""SELECT DISTINCT token, unicode(token)::BIGINT AS id FROM (SELECT unnest(string_split(text, '')) AS token FROM documents) WHERE token <> ''
        UNION ALL SELECT '<bos>', 2 UNION ALL SELECT '<eos>', 3""",
    token_ids=sql("ids", "SELECT doc_id, pos::INTEGER AS pos, id::BIGINT AS id FROM ids"),
    token_ids_equal_keys=sql(
        "ids", "SELECT doc_id % 3 AS doc_id, ids_md5 FROM (SELECT doc_id, md5(string_agg(id::VARCHAR, ' ' ORDER BY pos)) AS ids_md5 FROM ids GROUP BY doc_id)"
    ),
    model_embed_batch=sql(
        "ids",
        "SELECT doc_id, pos::INTEGER AS pos, (id % 7)::DOUBLE AS v0, (id % 11)::DOUBLE AS v1, 1::DOUBLE AS v2 FROM ids",
    ),
    mean_pool=sql("centers", elements("(SELECT qid AS label, v FROM centers)", "label", "v", 8)),
    vector_dim_report="""SELECT dim::INTEGER AS dim, count(*) AS n_vectors, dim <> 64 AS mismatch FROM
        (SELECT CASE WHEN vec_id % 10 = 0 THEN 32 ELSE len(embedding) END AS dim FROM embeddings) GROUP BY ALL""",
    embed_fallback="""SELECT doc_id, CASE WHEN d THEN 0 ELSE length(text) END::DOUBLE AS v0, CASE WHEN d THEN 0 ELSE 1 END::DOUBLE AS v1,
        CASE WHEN d THEN 'ValueError: digits' END AS embed_error FROM (SELECT doc_id, text, regexp_matches(text, '[0-9]') AS d FROM documents)""",
    cosine_pairs=sql("vecs", "centers", "SELECT doc_id, round(list_cosine_similarity(vec, v), 8) AS cosine FROM vecs JOIN centers ON label = qid"),
    vector_table=sql("hashed_docs", elements("hashed_docs", "doc_id", "v", 5)),
    exact_terms=sql("exact", "SELECT * FROM exact"),
    body_tokens=sql("tokens", "SELECT doc_id, pos::INTEGER AS pos, term FROM tokens"),
    postings=sql(
        "tokens",
        """SELECT term, doc_id, count(*)::INTEGER AS tf, any_value(dl)::INTEGER AS dl, string_agg(pos::VARCHAR, ' ' ORDER BY pos) AS positions FROM
            (SELECT *, count(*) OVER (PARTITION BY doc_id) AS dl FROM tokens) GROUP BY term, doc_id""",
    ),
    doc_lengths=sql("tokens", "SELECT doc_id, count(term)::INTEGER AS dl FROM mails LEFT JOIN tokens USING (doc_id) GROUP BY doc_id"),
    term_stats=sql("dfs", "SELECT * FROM dfs"),
    corpus_stats=sql("corpus", "SELECT n_docs, round(avgdl, 6) AS avgdl FROM corpus"),
    quantise_int8=sql(
        "codes",
        "SELECT doc_id, pos::INTEGER AS pos, code FROM (SELECT doc_id, unnest(codes) AS code, generate_subscripts(codes, 1) - 1 AS pos FROM codes)",
    ),
    quantise_error=sql(
        "codes",
        """SELECT count(DISTINCT doc_id) AS n_vectors, round(max(abs(x - y)), 8) AS max_error, round(avg(abs(x - y)), 8) AS mean_error,
            (count(*) * 4)::BIGINT AS float_bytes, count(*) AS code_bytes FROM (SELECT doc_id, unnest(vec) AS x, unnest(back) AS y FROM codes)""",
    ),
    ivf_assign="SELECT vec_id AS doc_id, 1::BIGINT AS n_cells, 0::BIGINT AS n_wrong FROM embeddings",
    knn_exact=sql("near", "SELECT qid::BIGINT AS qid, doc_id, score, rank::INTEGER AS rank FROM near"),
    knn_ragged=sql(
        "vecs", "centers",
        f"""SELECT qid::BIGINT AS qid, doc_id, score, rank::INTEGER AS rank FROM (SELECT *, {rank('score')} AS rank FROM (
            SELECT qid, doc_id, round(list_cosine_similarity(vec, v), 9) AS score FROM vecs CROSS JOIN centers WHERE doc_id % 5 > 1)) WHERE rank <= 20""",
    ),
    knn_cells_fixed=sql(
        "vecs", "centers",
        """SELECT qid::BIGINT AS qid, doc_id, score, rank::INTEGER AS rank FROM (
          WITH pts AS (SELECT doc_id, vec::DOUBLE[] AS m FROM vecs),
          to_coarse AS (SELECT p.doc_id, c.doc_id AS c, row_number() OVER (PARTITION BY p.doc_id
              ORDER BY round(list_cosine_similarity(p.m, c.m), 9) DESC, c.doc_id) AS r FROM pts p CROSS JOIN pts c WHERE c.doc_id < 4),
          home AS (SELECT doc_id, c FROM to_coarse WHERE r = 1),
          fine AS (SELECT p.doc_id AS f, p.m, h.c FROM pts p JOIN home h USING (doc_id) WHERE p.doc_id < 36),
          own AS (SELECT doc_id, f FROM (SELECT p.doc_id, f, row_number() OVER (PARTITION BY p.doc_id
              ORDER BY round(list_cosine_similarity(p.m, fine.m), 9) DESC, f) AS r
              FROM pts p JOIN home h USING (doc_id) JOIN fine ON fine.c = h.c) WHERE r = 1),
          near_coarse AS (SELECT qid, v, c FROM (SELECT qid, v, c.doc_id AS c, row_number() OVER (PARTITION BY qid
              ORDER BY round(list_cosine_similarity(v, c.m), 9) DESC, c.doc_id) AS r FROM centers CROSS JOIN pts c WHERE c.doc_id < 4) WHERE r <= 2),
          near_fine AS (SELECT qid, v, f FROM (SELECT qid, v, f, row_number() OVER (PARTITION BY qid
              ORDER BY round(list_cosine_similarity(v, m), 9) DESC, f) AS r FROM near_coarse JOIN fine USING (c)) WHERE r <= 9),
          scored AS (SELECT qid, doc_id, round(list_cosine_similarity(m, v), 9) AS score FROM near_fine JOIN own USING (f) JOIN pts USING (doc_id))
          SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 20""",
    ),
    knn_int8=sql("near_codes", "SELECT qid::BIGINT AS qid, doc_id, score, rank::INTEGER AS rank FROM near_codes WHERE rank <= 20"),
    knn_int8_rescored=sql(
        "near_codes",
        f"""SELECT * FROM (SELECT qid::BIGINT AS qid, doc_id, score, {rank('score')}::INTEGER AS rank FROM
            (SELECT qid, doc_id, full_score AS score FROM near_codes WHERE rank <= 80)) WHERE rank <= 20""",
    ),
    match_sender=sql("exact", "wanted", "SELECT qid, doc_id FROM exact JOIN wanted USING (field, term) WHERE field = 'sender_email'"),
    match_phone=sql(
        "exact", "SELECT min(doc_id) OVER (PARTITION BY term) AS qid, doc_id FROM exact WHERE field = 'phone_num'"
    ),
    bm25_any=sql(
        "posted", "dfs", "corpus", "text_wanted",
        """SELECT w.qid, p.doc_id, round(sum(w.n * ln(1 + (c.n_docs - d.df + 0.5) / (d.df + 0.5))
              * p.tf / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / c.avgdl))), 8) AS score
           FROM posted p JOIN text_wanted w USING (term) JOIN dfs d USING (term) CROSS JOIN corpus c GROUP BY ALL""",
    ),
    bm25_top=sql(
        "text_scores",
        f"""SELECT qid, doc_id, rank::INTEGER AS rank, round(score, 8) AS score
            FROM (SELECT *, {rank('score')} AS rank FROM text_scores) WHERE rank <= 20""",
    ),
    bm25_byte_length=sql(
        "posted", "dfs", "corpus", "text_wanted",
        """SELECT w.qid, p.doc_id, round(sum(w.n * ln(1 + (c.n_docs - d.df + 0.5) / (d.df + 0.5))
              * p.tf / (p.tf + 1.2 * (0.25 + 0.75 * p.kept / c.avgdl))), 8) AS score
           FROM (SELECT *, CASE WHEN dl < 40 THEN dl ELSE 24 + (((dl - 24) >> s) << s) END AS kept FROM
                  (SELECT *, greatest(floor(log2(greatest(dl - 24, 1)))::INTEGER - 3, 0) AS s FROM posted)) p
           JOIN text_wanted w USING (term) JOIN dfs d USING (term) CROSS JOIN corpus c GROUP BY ALL""",
    ),
    match_raw_term=sql(
        "posted", "dfs", "corpus",
        """SELECT b.item_id AS qid, p.doc_id, round(ln(1 + (c.n_docs - d.df + 0.5) / (d.df + 0.5))
              * p.tf / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / c.avgdl)), 8) AS score
           FROM benchmark b JOIN posted p ON p.term = lower(string_split(b.text, ' ')[1]) JOIN dfs d USING (term) CROSS JOIN corpus c""",
    ),
    keyword_search=sql("keyword", "SELECT qid, doc_id, rank::INTEGER AS rank, round(score, 8) AS score FROM keyword"),
    rrf_contrib=sql("near", "SELECT qid::BIGINT AS qid, doc_id, rank::INTEGER AS rank, round(1.0::DOUBLE / (60 + rank), 9) AS rrf FROM near"),
    rrf_fuse=sql(
        "fused",
        "SELECT qid::BIGINT AS qid, doc_id, round(rrf_score, 9) AS rrf_score, semantic_rank::INTEGER AS semantic_rank, keyword_rank::INTEGER AS keyword_rank FROM fused",
    ),
    hybrid_topk=sql(
        "fused_top",
        """SELECT qid::BIGINT AS qid, doc_id, round(rrf_score, 9) AS rrf_score, semantic_rank::INTEGER AS semantic_rank,
            keyword_rank::INTEGER AS keyword_rank, rank::INTEGER AS rank FROM fused_top""",
    ),
    hydrate_hits=sql(
        "fused_top", "mails",
        f"""SELECT qid::BIGINT AS qid, rank::INTEGER AS rank, doc_id, message_id, from_email, from_name, all_recipients, subject,
            {cut('body_content')} AS body_snippet, body_content, timestamp_ms, has_attachments, labels, round(rrf_score, 6) AS rrf_score,
            semantic_rank::INTEGER AS semantic_rank, keyword_rank::INTEGER AS keyword_rank FROM fused_top JOIN mails USING (doc_id)""",
    ),
    hybrid_search=sql("hits", "SELECT * FROM hits"),
    search_neither="SELECT 0::BIGINT AS qid, 0::INTEGER AS rank, 0::BIGINT AS doc_id, 0::DOUBLE AS rrf_score WHERE false",
    search_mixed_legs=sql("hits", "SELECT * FROM hits WHERE qid % 3 <> 0"),
    semantic_only=sql(
        "semantic",
        "SELECT qid, rank::INTEGER AS rank, doc_id, round(1.0::DOUBLE / (60 + rank), 6) AS rrf_score, rank::INTEGER AS semantic_rank FROM semantic",
    ),
    keyword_only=sql(
        "keyword",
        "SELECT qid, rank::INTEGER AS rank, doc_id, round(1.0::DOUBLE / (60 + rank), 6) AS rrf_score, rank::INTEGER AS keyword_rank FROM keyword",
    ),
    match_all=sql(
        "posted", "few_words",
        """SELECT qid::BIGINT AS qid, doc_id FROM posted JOIN few_words USING (term) GROUP BY qid, doc_id
           HAVING count(*) = (SELECT count(*) FROM few_words f WHERE f.qid = few_words.qid)""",
    ),
    match_none=sql(
        "posted", "few_words",
        """SELECT DISTINCT qid::BIGINT AS qid, doc_id FROM posted JOIN few_words USING (term) WHERE (qid, doc_id) NOT IN (
            SELECT (u.qid, p.doc_id) FROM posted p JOIN (VALUES (1, 'en'), (2, 'les'), (2, 'un'), (3, 'die')) AS u(qid, term) USING (term))""",
    ),
    match_phrase=sql(
        "tokens", "phrase_words",
        """SELECT qid, doc_id, count(*)::INTEGER AS n_places FROM (
            SELECT qid, doc_id, start FROM (SELECT qid, doc_id, pos - place AS start FROM tokens JOIN phrase_words USING (term))
            JOIN (SELECT qid, count(*) AS n FROM phrase_words GROUP BY qid) USING (qid)
            GROUP BY qid, doc_id, start, n HAVING count(*) = n) GROUP BY ALL""",
    ),
    match_phrase_slop=sql(
        "tokens", "few_words",
        """, starts AS (SELECT qid, place, doc_id, pos - place AS s FROM tokens JOIN few_words USING (term)),
        near_starts AS (SELECT DISTINCT a.qid, a.doc_id, a.s, b.place FROM (SELECT DISTINCT qid, doc_id, s FROM starts) a
            JOIN starts b ON a.qid = b.qid AND a.doc_id = b.doc_id AND b.s BETWEEN a.s AND a.s + 3)
        SELECT qid::BIGINT AS qid, doc_id, count(*)::INTEGER AS n_places FROM (
            SELECT qid, doc_id, s FROM near_starts JOIN (SELECT qid, count(*) AS n FROM few_words GROUP BY qid) USING (qid)
            GROUP BY qid, doc_id, s, n HAVING count(*) = n) GROUP BY ALL""",
    ),
    # No phrase holds a word more than twice, so its two places part once both together have two positions.
    match_phrase_slop_repeats=sql(
        "tokens", "double_words",
        """, starts AS (SELECT qid, place, term, doc_id, pos, pos - place AS s FROM tokens JOIN double_words USING (term)),
        near_starts AS (SELECT a.qid, a.doc_id, a.s, b.term, count(DISTINCT b.place) AS n_found, count(DISTINCT b.pos) AS n_pos
            FROM (SELECT DISTINCT qid, doc_id, s FROM starts) a
            JOIN starts b ON a.qid = b.qid AND a.doc_id = b.doc_id AND b.s BETWEEN a.s AND a.s + 3 GROUP BY ALL)
        SELECT qid::BIGINT AS qid, doc_id, count(*)::INTEGER AS n_places FROM (
            SELECT qid, doc_id, s FROM near_starts JOIN (SELECT qid, count(*) AS n FROM double_words GROUP BY qid) USING (qid)
            GROUP BY qid, doc_id, s, n HAVING sum(n_found) = n AND bool_and(n_pos >= n_found)) GROUP BY ALL""",
    ),
    match_prefix=sql("posted", "SELECT DISTINCT doc_id FROM posted WHERE starts_with(term, 'aich')"),
    match_wildcard=sql("posted", "SELECT DISTINCT doc_id FROM posted WHERE term LIKE 'a_ch%en'"),
    match_regex=sql("posted", "SELECT DISTINCT doc_id FROM posted WHERE regexp_full_match(term, '(un|die)[a-m]{2,4}')"),
    match_fuzzy=sql(
        "posted", "SELECT doc_id, min(levenshtein(term, 'another'))::INTEGER AS edits FROM posted WHERE levenshtein(term, 'another') <= 2 GROUP BY doc_id"
    ),
    match_fuzzy_swaps=sql(
        "posted",
        "SELECT doc_id, min(damerau_levenshtein(term, 'aihc'))::INTEGER AS edits FROM posted WHERE damerau_levenshtein(term, 'aihc') <= 1 GROUP BY doc_id",
    ),
    match_range=sql("posted", "SELECT DISTINCT doc_id FROM posted WHERE term BETWEEN 'zed' AND 'zz'"),
    match_patterns=sql("pattern_docs", "SELECT * FROM pattern_docs"),
    match_fuzzy_words=sql("fuzzy_docs", "SELECT * FROM fuzzy_docs"),
    match_fuzzy_swapped=sql(
        "posted", "letters", "misspelt",
        """SELECT qid, doc_id, max(round(greatest(1 - edits / least(length(word), length(term)), 0), 8)) AS score FROM
              (SELECT qid, word, term, damerau_levenshtein(word, letters) AS edits FROM misspelt, letters
               WHERE damerau_levenshtein(word, letters) <= 1) JOIN posted USING (term) GROUP BY ALL""",
    ),
    match_ranges=sql(
        "posted", "dfs", "asked_words",
        """SELECT DISTINCT qid, doc_id, 1.0::DOUBLE AS score FROM (SELECT qid, term FROM asked_words, dfs WHERE
              CASE WHEN qid % 10 = 0 THEN term >= 'zo'
                   WHEN qid % 2 = 0 THEN term BETWEEN word AND word[1:4] || 'z'
                   ELSE term > word AND term <= word[1:4] || 'z' END) JOIN posted USING (term)""",
    ),
    match_clause_sum=sql(
        "text_scores", "pattern_docs", "fuzzy_docs",
        f"""SELECT qid, doc_id, rank::INTEGER AS rank, round(score, 8) AS score FROM (SELECT *, {rank('score')} AS rank FROM
            (SELECT qid, doc_id, sum(score) AS score FROM (SELECT * FROM text_scores
               UNION ALL SELECT qid, doc_id, score * 2 FROM pattern_docs
               UNION ALL SELECT qid, doc_id, score * 0.5 FROM fuzzy_docs) GROUP BY ALL)) WHERE rank <= 20""",
    ),
    match_boost=sql(
        "exact_part", "body_part",
        f"""SELECT qid, doc_id, rank::INTEGER AS rank, round(score, 8) AS score FROM (SELECT *, {rank('score')} AS rank FROM (
            SELECT qid, doc_id, sum(score) AS score FROM (SELECT qid, doc_id, score * 3 AS score FROM exact_part
              UNION ALL SELECT * FROM body_part) GROUP BY ALL)) JOIN searches USING (qid) WHERE rank <= max_results""",
    ),
)
# Probing every cell, and the exact search, give one and the same list.
ORACLE["knn_ivf"] = ORACLE["knn_exact"]
ORACLE["knn_cells_int8"] = ORACLE["knn_int8_rescored"]
# So do codes of every cell, ranked again by full vectors, as far as four times as many as asked hold them.
ORACLE["hybrid_search_cells"] = ORACLE["hybrid_search"]
