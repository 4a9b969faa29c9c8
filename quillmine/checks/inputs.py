"""Operator inputs derived from the driver tables.

Each input is written once as portable SQL, run by Spark for the job and by DuckDB
for the oracle, so both sides start from identical rows.  Only rows that need an
unnest are written per engine.  ``{name}`` refers to a driver table or another input.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmine.session import cut_lineage, ship_package
from quillmine.sources.tables import read_table

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

PORTABLE: dict[str, str] = {}
SPARK_ONLY: dict[str, str] = {}
DUCK_ONLY: dict[str, str] = {}

# Documents as wiki, tracker and generic pages.
PORTABLE["doc_pages"] = """
SELECT doc_id,
       'https://' || source || '.example.org/doc/' || CAST(doc_id AS VARCHAR(20)) AS page_url,
       substr(split_part(text, chr(10), 1), 1, 80) AS title,
       text AS markdown,
       CASE CAST(substr(source, 4) AS BIGINT) % 3
            WHEN 0 THEN 'confluence' WHEN 1 THEN 'jira' ELSE 'generic' END AS source_type
FROM {documents}
"""

# Rows as they arrive: missing fields, odd blanks, aliases, unknown types.
PORTABLE["raw_pages"] = """
SELECT doc_id,
       CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN '  ' || source || ' notes' || chr(9)
            ELSE substr(split_part(text, chr(10), 1), 1, 80) END AS title,
       CASE doc_id % 8
            WHEN 0 THEN 'https://team.atlassian.net/browse/KEY-' || CAST(doc_id AS VARCHAR(20))
            WHEN 1 THEN 'https://team.atlassian.net/wiki/spaces/' || source || '/Page-' || CAST(doc_id AS VARCHAR(20)) || '/'
            WHEN 2 THEN ' https://Wiki.Example.org/a//b/' || source || '/?q=1#top '
            WHEN 3 THEN 'https://example.net'
            WHEN 4 THEN ''
            WHEN 5 THEN NULL
            WHEN 6 THEN 'notes about ' || source
            ELSE 'https://jira.example.com/x/' || source || ';v=2' END AS url,
       CASE doc_id % 11 WHEN 0 THEN '   ' || chr(10) WHEN 1 THEN NULL ELSE '  ' || text || chr(10) END AS markdown,
       CASE doc_id % 7 WHEN 0 THEN ' JIRA ' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN 'blog'
            WHEN 4 THEN 'Confluence' ELSE 'generic' END AS source_type,
       CASE doc_id % 6 WHEN 0 THEN ' Current_Page' WHEN 1 THEN 'compare_anchor' WHEN 2 THEN 'reference_context'
            WHEN 3 THEN 'other' WHEN 4 THEN '' ELSE NULL END AS context_role
FROM {documents}
"""

# The user turns of all conversations as questions.
PORTABLE["turn_questions"] = """
SELECT conv_id * 1000 + turn AS query_id, text AS question,
       CASE (conv_id + turn) % 5 WHEN 0 THEN 'answer' WHEN 1 THEN 'critique' WHEN 2 THEN ' Diagram '
            WHEN 3 THEN 'other' ELSE '' END AS raw_mode,
       CASE (conv_id + turn) % 5 WHEN 1 THEN 'critique' WHEN 2 THEN 'diagram' ELSE 'answer' END AS mode
FROM {conversations} WHERE role = 'user'
"""

# Every document goes into the basket of one conversation; its user turns ask over it.
PORTABLE["dealt_pages"] = """
SELECT page_url, turn_no AS original_index, (doc_id + turn_no) % convs AS conv_id
FROM (SELECT page_url, doc_id, convs, CAST(floor(doc_id / convs) AS BIGINT) AS turn_no
      FROM (SELECT page_url, doc_id, (SELECT max(conv_id) + 1 FROM {conversations}) AS convs FROM {doc_pages}) a) b
"""
PORTABLE["turn_basket"] = """
SELECT t.conv_id * 1000 + t.turn AS query_id, p.page_url, p.original_index,
       CASE WHEN t.conv_id % 4 = 1 AND p.original_index = 0 THEN 'compare_anchor'
            WHEN t.conv_id % 4 = 1 THEN 'reference_context'
            WHEN t.conv_id % 4 = 2 AND p.original_index = 0 THEN 'current_page'
            ELSE 'default' END AS context_role
FROM {conversations} t JOIN {dealt_pages} p ON p.conv_id = t.conv_id
WHERE t.role = 'user'
"""

# Lines of all documents as chunks; whole texts, blank lines dropped.
SPARK_ONLY["line_chunks"] = """
SELECT page_url, title AS page_title, source_type, CAST(pos AS BIGINT) AS chunk_index,
       CAST(size(lines) AS BIGINT) AS total_chunks, text
FROM (SELECT page_url, title, source_type,
             filter(split(markdown, '\\n'), x -> trim(x) != '') AS lines FROM {doc_pages})
LATERAL VIEW posexplode(lines) t AS pos, text
"""
DUCK_ONLY["line_chunks"] = """
SELECT page_url, title AS page_title, source_type,
       CAST(generate_subscripts(lines, 1) - 1 AS BIGINT) AS chunk_index,
       CAST(len(lines) AS BIGINT) AS total_chunks, unnest(lines) AS text
FROM (SELECT page_url, title, source_type,
             list_filter(string_split(markdown, chr(10)), lambda x: trim(x, ' ') <> '') AS lines
      FROM {doc_pages})
"""

# One policy page per supplier, one question per ten suppliers.
PORTABLE["policy_pages"] = """
SELECT s_suppkey, CAST(floor(s_suppkey / 10) AS BIGINT) AS query_id, s_suppkey % 10 AS original_index,
       'https://ops' || CAST(s_suppkey % 3 AS VARCHAR(20)) || '.example.org/policy/' || CAST(s_suppkey AS VARCHAR(20)) AS page_url,
       'Policy ' || s_name AS title,
       CASE s_suppkey % 3 WHEN 0 THEN 'confluence' WHEN 1 THEN 'jira' ELSE 'generic' END AS source_type,
       CASE s_suppkey % 2 WHEN 0 THEN '# Design notes for ' ELSE '# Runbook for ' END || s_name || chr(10) || chr(10)
       || 'Gateway timeout for the ' || n_name || ' validation service is ' || CAST(s_suppkey % 4 * 15 + 15 AS VARCHAR(20)) || ' seconds. '
       || 'Client version v2.' || CAST(s_suppkey % 3 AS VARCHAR(20)) || '.1 keeps a refresh duration of ' || CAST(s_suppkey % 5 + 1 AS VARCHAR(20)) || ' hours!' || chr(10)
       || 'The export feature for premium account holders is '
       || CASE s_suppkey % 2 WHEN 0 THEN 'enabled' ELSE 'disabled' END || ' and ' || CASE s_suppkey % 3 WHEN 0 THEN 'optional' ELSE 'required' END || '.' || chr(10)
       || '[note] retry backoff attempts wait 3 seconds in this bracketed line.' || chr(10)
       || 'Retry attempts towards the billing gateway wait ' || CAST(s_suppkey % 6 + 2 AS VARCHAR(20)) || ' seconds between calls? '
       || 'Short one. The request quota per minute for gateway clients grows by 12.5% each release of the billing gateway.' AS markdown
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
"""
PORTABLE["policy_chunks"] = """
SELECT query_id, original_index AS position, page_url, title AS page_title, source_type,
       CAST(0 AS BIGINT) AS chunk_index, CAST(1 AS BIGINT) AS total_chunks, markdown AS text
FROM {policy_pages}
"""

# One anchor per order, on the page of its customer.
PORTABLE["anchors"] = """
SELECT 'https://wiki.example.org/c/' || CAST(o_custkey AS VARCHAR(20)) AS src_url,
       o_orderkey AS anchor_index,
       CASE o_orderkey % 9
            WHEN 0 THEN 'https://team.atlassian.net/browse/ORD-' || CAST(o_custkey % 40 AS VARCHAR(20))
            WHEN 1 THEN 'https://team.atlassian.net/wiki/spaces/OPS/' || 'Order%20guide-' || CAST(o_custkey % 30 AS VARCHAR(20))
            WHEN 2 THEN 'https://github.com/acme/repo' || CAST(o_custkey % 20 AS VARCHAR(20)) || '/issues/' || CAST(o_orderkey % 13 AS VARCHAR(20))
            WHEN 3 THEN 'https://docs.google.com/document/d/' || CAST(o_orderkey % 101 AS VARCHAR(20))
            WHEN 4 THEN 'https://shop.example.com/item/' || CAST(o_orderkey % 50 AS VARCHAR(20))
            WHEN 5 THEN 'https://wiki.example.org/c/' || CAST(o_custkey AS VARCHAR(20))
            WHEN 6 THEN 'https://notion.so/Team_plan+' || CAST(o_custkey % 10 AS VARCHAR(20)) || '/'
            WHEN 7 THEN 'https://CONFLUENCE.example.org/display/ops'
            ELSE 'https://host.example.org/project/readme.md' END AS url,
       CASE o_orderkey % 6 WHEN 0 THEN 'here' WHEN 1 THEN '' WHEN 2 THEN 'x' WHEN 3 THEN 'Order ' || o_orderpriority
            WHEN 4 THEN 'design of ' || o_orderpriority || ' orders' ELSE o_orderstatus || ' bug' END AS link_text,
       CASE o_orderkey % 4 WHEN 0 THEN ''
            WHEN 1 THEN 'This long line tells how the team handles priority ' || o_orderpriority || ' and links to '
                 || CASE o_orderkey % 6 WHEN 0 THEN 'here' WHEN 1 THEN '' WHEN 2 THEN 'x' WHEN 3 THEN 'Order ' || o_orderpriority
                    WHEN 4 THEN 'design of ' || o_orderpriority || ' orders' ELSE o_orderstatus || ' bug' END
                 || ' for the people who want more of the background, see also the notes that follow on all the later pages of it'
            WHEN 2 THEN 'Filed under status ' || o_orderstatus || ' on ' || CAST(o_custkey AS VARCHAR(20)) || ', a sentence without the anchor text but long enough to be cut somewhere after one hundred and fifty characters of plain words'
            ELSE 'Go to Order ' || o_orderpriority END AS parent_text,
       o_orderkey % 3 = 0 AS in_list, o_orderkey % 7 = 0 AS in_nav,
       CASE o_orderkey % 10 WHEN 0 THEN 'btn-primary' WHEN 1 THEN 'link external' ELSE '' END AS classes
FROM {orders}
"""
PORTABLE["linked_pins"] = """
SELECT DISTINCT url FROM {anchors} WHERE link_text LIKE '%1-URGENT%'
"""

# The labelled documents are the pinned ones; content may be missing.
PORTABLE["pinned"] = """
SELECT 'pin-' || CAST(d.doc_id AS VARCHAR(20)) AS id, d.title, d.page_url AS url,
       CAST(length(d.markdown) AS BIGINT) AS size_chars, d.doc_id
FROM {doc_pages} d JOIN {labels} l ON d.doc_id = l.doc_id
"""
PORTABLE["pinned_content"] = """
SELECT 'pin-' || CAST(d.doc_id AS VARCHAR(20)) AS id,
       CASE l.toxic WHEN 1 THEN '  ' ELSE '  ' || d.markdown || ' ' END AS markdown
FROM {doc_pages} d JOIN {labels} l ON d.doc_id = l.doc_id WHERE l.quality = 1
"""

# Documents twice: once as they are, once under a noisy URL and with noisy text.
# Three near pages (same URL, same text, both) land in one basket.
PORTABLE["near_pages"] = """
SELECT CAST(floor(doc_id / 10) AS BIGINT) AS query_id, (doc_id % 10) * 2 AS original_index, doc_id * 2 AS page_no,
       'https://docs.example.org/Area/' || CAST(CAST(floor(doc_id / 3) AS BIGINT) AS VARCHAR(20)) AS page_url, text AS markdown,
       CASE CAST(substr(source, 4) AS BIGINT) % 3 WHEN 0 THEN 'confluence' WHEN 1 THEN 'jira' ELSE 'generic' END AS source_type,
       source AS title
FROM {documents}
UNION ALL
SELECT CAST(floor(doc_id / 10) AS BIGINT) AS query_id, (doc_id % 10) * 2 + 1 AS original_index, doc_id * 2 + 1 AS page_no,
       CASE doc_id % 4 WHEN 0 THEN 'HTTPS://Docs.Example.org//area/' || CAST(CAST(floor(doc_id / 3) AS BIGINT) AS VARCHAR(20)) || '/?v=1'
            WHEN 1 THEN 'https://docs.example.org/copy/' || CAST(doc_id AS VARCHAR(20)) || '#x'
            WHEN 2 THEN 'https://docs.example.org/area/' || CAST(CAST(floor(doc_id / 3) + 1 AS BIGINT) AS VARCHAR(20))
            ELSE '' END AS page_url,
       CASE doc_id % 3 WHEN 0 THEN '  ' || lower(text) WHEN 1 THEN text || ' ' ELSE text || ' more of ' || lang END AS markdown,
       'generic' AS source_type, source || ' copy' AS title
FROM {documents}
"""

# Stored answers: one per part.
PORTABLE["responses"] = """
SELECT p_partkey AS response_id, p_partkey % 10 AS kind, p_name, p_type, p_brand,
       CASE p_partkey % 10
         WHEN 0 THEN 'Here it is:' || chr(10) || '```json' || chr(10) || '{"summary": "Review of ' || p_name || '", "issues": ['
              || '{"title": "Missing timeout for ' || p_name || '", "severity": "HIGH", "category": "reliability", "evidence": "the ' || p_type || ' gateway has no timeout", "risk": "Calls hang for ' || p_name || ' users", "suggestion": "Add a timeout to the gateway", "source_title": "Spec ' || p_brand || '"},'
              || '{"title": "No owner", "severity": "urgent", "risk": "Nobody reacts", "suggestion": " Name an owner "},'
              || '{"title": "", "severity": "low", "risk": "r", "suggestion": "s"}, "not an object"]}' || chr(10) || '```'
         WHEN 1 THEN '{"summary": "", "issues": [{"title": "Quota of ' || p_type || ' unclear", "severity": "low", "category": "", "risk": "Limits differ", "suggestion": "State the quota"}, {"title": "x", "risk": "", "suggestion": "y"}, {"title": "Third ' || p_brand || '", "risk": "a", "suggestion": "b", "evidence": "quoted ' || chr(92) || '"the ' || p_name || ' part has a fixed size' || chr(92) || '" there"}, {"title": "Fourth", "risk": "a", "suggestion": "b"}, {"title": "Fifth", "risk": "a", "suggestion": "b"}, {"title": "Sixth", "risk": "a", "suggestion": "b"}]}'
         WHEN 2 THEN 'Some prose before {"summary": "only text ' || p_brand || '", "issues": "none"} and after'
         WHEN 3 THEN 'Broken {"summary": "no end ' || p_name || '"'
         WHEN 4 THEN 'The flow of ' || p_name || ':' || chr(10) || chr(10) || chr(10) || chr(10) || '```mermaid' || chr(10) || 'sequenceDiagram' || chr(10) || '  A->>B: ' || p_type || chr(10) || '```' || chr(10) || 'Done.'
         WHEN 5 THEN 'flowchart TD' || chr(10) || '  A --> ' || p_brand || '   ' || chr(10) || chr(10)
         WHEN 6 THEN '```Mermaid graph LR ```'
         WHEN 7 THEN 'Answer about ' || p_name || '.' || chr(10) || '---' || chr(10) || chr(10) || '💡 **Missing Information:**' || chr(10)
              || '- ' || p_type || ' - details of the version in use' || chr(10) || '- Supplier ' || p_brand || ' - a page that explains who delivers it' || chr(10)
              || 'Keywords to search: ' || p_name || ', ' || p_brand || '; limits'
         WHEN 8 THEN '💡 **Missing Information:**' || chr(10) || '- Size - short text' || chr(10)
         ELSE '- not - a suggestion, just a list about ' || p_name END AS text
FROM {part}
"""
for _name, _items in (("part_issues", (1, 2, 3)), ("part_blocks", (1, 2, 3, 4))):
    SPARK_ONLY[_name] = f"SELECT *, explode(array({', '.join(f'{i}L' for i in _items)})) AS n FROM {{part}}"
    DUCK_ONLY[_name] = f"SELECT *, unnest({list(_items)}::BIGINT[]) AS n FROM {{part}}"
PORTABLE["issue_rows"] = """
SELECT p_partkey AS response_id, i.n AS issue_index,
       CASE (p_partkey + i.n) % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END AS severity,
       'Check ' || p_name || ' handling ' || CAST(i.n AS VARCHAR(20)) AS title,
       CASE (p_partkey + i.n) % 3
            WHEN 0 THEN 'the ' || p_name || ' is stored in ' || p_type || ' boxes of size ' || CAST(p_size AS VARCHAR(20))
            WHEN 1 THEN '"approx. every ' || p_type || ' order leaves the depot" says the page. Another longer sentence about ' || p_brand || ' follows here'
            ELSE 'paraphrased: depot ' || p_type END AS evidence,
       'Orders of ' || p_type || ' parts may leave late from depot' AS risk,
       'Check boxes for ' || p_name AS suggestion,
       CASE (p_partkey + i.n) % 5 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'Guide to (' || p_brand || ') ' || p_type || ' stock'
            ELSE 'Guide to ' || p_type || ' depot stock' END AS source_title,
       'Guide to ' || p_type || ' depot stock list' AS page_title
FROM {part_issues} i
"""
PORTABLE["text_blocks"] = """
SELECT p_partkey AS response_id, b.n AS block_index,
       CASE b.n WHEN 1 THEN 'The   ' || p_name || ' is stored in ' || upper(p_type) || ' boxes of size ' || CAST(p_size AS VARCHAR(20)) || ' and more'
            WHEN 2 THEN 'Depot rules: every ' || p_type || ' order leaves the depot' || chr(10) || 'before noon, late orders wait for the next boxes'
            WHEN 3 THEN 'Unrelated words about weather and sports news of ' || p_brand
            ELSE 'Parts check list: handling of ' || p_name || ', boxes, orders, depot, risk' END AS text
FROM {part_blocks} b
"""
PORTABLE["bench_runs"] = """
SELECT event_id AS run, event_type AS label, value AS client_ms,
       CASE event_id % 3 WHEN 0 THEN 0.0 WHEN 1 THEN NULL ELSE value * 2 END AS server_ms,
       CASE event_id % 5 WHEN 0 THEN NULL ELSE value / 2 END AS retrieval_ms,
       CASE event_type WHEN 'error' THEN NULL ELSE value * 3 END AS generation_ms,
       CAST(user_id % 4 AS DOUBLE) AS ttft_ms,
       CASE user_id % 2 WHEN 0 THEN 'openai' ELSE 'ollama' END AS provider
FROM {events}
"""

_REF = re.compile(r"(?<!\\x)\{([a-z_]+)\}")


def _refs(sql: str) -> list[str]:
    return [name for name in dict.fromkeys(_REF.findall(sql)) if name not in TABLES]


def _order(sql: str, texts: dict[str, str], seen: list[str]) -> list[str]:
    for name in _refs(sql):
        if name not in seen:
            _order(texts[name], texts, seen)
            seen.append(name)
    return seen


def with_inputs(sql: str) -> str:
    """Oracle SQL with every ``{input}`` it names put in front as a CTE."""
    texts = {**PORTABLE, **DUCK_ONLY}
    ctes = [f"{n} AS ({_REF.sub(r'\1', texts[n]).strip()})" for n in _order(sql, texts, [])]
    body = _REF.sub(r"\1", sql).strip()
    if not ctes:
        return body
    head = "WITH " + ",\n".join(ctes)
    for start, opening in (("WITH RECURSIVE ", "WITH RECURSIVE "), ("WITH ", "WITH ")):
        if body.startswith(start):
            return opening + head[5:] + ",\n" + body[len(start):]
    return head + "\n" + body


class Inputs:
    """Inputs as DataFrames: ``inputs.documents``, ``inputs.doc_pages`` and so on."""

    def __init__(self, spark: SparkSession, folder: str):
        ship_package(spark)
        self.spark = spark
        self.folder = folder
        self._made: dict[str, DataFrame] = {}
        self._views: set[str] = set()

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A stage result several later stages read: checkpointed, so it is computed once."""
        if name not in self._made:
            self._made[name] = cut_lineage(make())
        return self._made[name]

    def _view(self, name: str) -> str:
        """A temporary view of a driver table; its name holds the folder it reads."""
        view = f"quillmine_{name}_{hashlib.md5(self.folder.encode()).hexdigest()[:8]}"
        if name not in self._views:
            read_table(self.spark, f"{self.folder}/{name}.parquet").createOrReplaceTempView(view)
            self._views.add(name)
        return view

    def _sql(self, name: str) -> str:
        if name in TABLES:
            return self._view(name)
        text = SPARK_ONLY.get(name) or PORTABLE[name]
        return "(" + _REF.sub(lambda m: self._sql(m.group(1)), text).strip() + ")"

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.table(self._view(name))
        if name in PORTABLE or name in SPARK_ONLY:
            return self.spark.sql(f"SELECT * FROM {self._sql(name)}")
        raise AttributeError(name)
