"""DuckDB SQL for the queries that SQL can express."""

ORACLE: dict[str, str] = {}

#: A-Z to lower case, all else as it is.
LOWER = "translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE["op3_line_dedup"] = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (SELECT doc_id, pos, line, trim({LOWER}, {BLANKS}) AS key FROM lines),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.keeper AS dropped FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(dropped AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

#: A control string of the chat template, or of the vocabulary, behind any number of backslashes.
LOOKS_LIKE_CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]|TURN\])|\|endoftext\|>)"

ORACLE["op11_chat_format"] = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), written AS (
  SELECT *, length(regexp_replace(text, '{LOOKS_LIKE_CONTROL}', '\1\\\2\3', 'g')) + CASE role
    WHEN 'user' THEN 13 WHEN 'assistant' THEN 4
    ELSE 17 + length(regexp_replace(role, '{LOOKS_LIKE_CONTROL}', '\1\\\2\3', 'g')) END AS chars
  FROM turns
), joined AS (
  SELECT conv_id, count(*) AS n_turns, sum(chars) AS chars,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss
  FROM written GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(3 + chars AS BIGINT) AS formatted_chars
FROM joined
"""

#: Counts that may be null are doubles here, as pandas shows nullable integers of Spark.
ORACLE["op12_fill_in_middle"] = """
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens
  FROM documents
), drawn AS (
  SELECT doc_id, text, tokens, len(tokens) AS n,
         CAST('0x' || h[1:8] AS BIGINT) % (len(tokens) + 1) AS one, CAST('0x' || h[9:16] AS BIGINT) % (len(tokens) + 1) AS two,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM hashed
), cut AS (
  SELECT doc_id, text, n, form,
         array_to_string(tokens[1:least(one, two)], '') AS prefix,
         array_to_string(tokens[least(one, two) + 1:greatest(one, two)], '') AS middle,
         array_to_string(tokens[greatest(one, two) + 1:], '') AS suffix
  FROM drawn
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS DOUBLE) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS DOUBLE) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""
