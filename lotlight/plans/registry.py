"""Registry of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

#: Canonical views in the twin's SQL; a query names those it needs.
VIEWS = {
    "lots": "SELECT o_orderkey AS lot_id, CAST(o_orderdate AS DATE) AS publish_date, o_custkey AS customer, o_totalprice AS price, CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'AIS_GZ' ELSE 'EM' END AS platform FROM orders",
    "relations": "SELECT x.lot_id, x.supplier_id, x.is_winner, lots.publish_date, lots.platform FROM (SELECT l_orderkey AS lot_id, l_suppkey AS supplier_id, bool_or(l_returnflag = 'R') AS is_winner FROM lineitem GROUP BY 1, 2) x JOIN lots ON lots.lot_id = x.lot_id",
    "observed": "SELECT * FROM relations WHERE (platform = 'AIS_GZ' AND is_winner) OR platform = 'EM'",
    "items": "SELECT l_orderkey AS lot_id, lots.publish_date, p_name AS name, p_type || '.' || p_brand || '.' || CAST(p_size AS VARCHAR) AS code, p_type || '.' || p_brand AS code_group, p_type AS code_class, l_partkey AS part FROM lineitem JOIN part ON p_partkey = l_partkey JOIN lots ON lots.lot_id = l_orderkey",
    "products": "SELECT p_partkey AS part, p_name || CASE WHEN p_size % 3 = 0 THEN ' b' || split_part(p_brand, '#', 2) || '-' || p_size ELSE '' END AS text, CASE WHEN p_size = 50 THEN NULL WHEN p_size % 10 = 0 THEN p_type || '.' || p_brand WHEN p_size % 10 = 5 THEN p_type || '.' || p_brand || '.' || p_size // 10 ELSE p_type || '.' || p_brand || '.' || p_size // 10 || '.' || p_size % 10 END AS code, CASE WHEN p_size <> 50 THEN p_type END AS code_class, CASE WHEN p_size <> 50 THEN p_type || '.' || p_brand END AS code_group, CASE WHEN p_size % 10 <> 0 THEN p_type || '.' || p_brand || '.' || p_size // 10 END AS code_kind FROM part",
    "goods": "SELECT x.lot_id, x.part, x.line, lots.publish_date, text, code, code_class, code_group, code_kind FROM (SELECT l_orderkey AS lot_id, l_partkey AS part, min(l_linenumber) AS line FROM lineitem GROUP BY 1, 2) x JOIN products ON products.part = x.part JOIN lots ON lots.lot_id = x.lot_id",
    "tokens": "SELECT DISTINCT p_partkey AS part, unnest(string_split(p_name, ' ')) AS token FROM part",
}


def query(sql: str | None = None, views: str = ""):
    """Register a function of (spark, sf_dir) under its own name."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            names = views.split()
            head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
            body = sql.strip()
            if not head:
                SQL[f.__name__] = body
            elif body.upper().startswith("WITH "):
                SQL[f.__name__] = f"WITH {head}, {body[5:]}"
            else:
                SQL[f.__name__] = f"WITH {head} {body}"
        return f

    return wrap
