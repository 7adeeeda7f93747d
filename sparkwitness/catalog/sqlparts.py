"""SQL forms of the identity encoding, for the oracles."""


def framed(*exprs: str) -> str:
    cells = [
        f"CASE WHEN {e} IS NULL THEN '-;' ELSE concat(CAST(strlen(CAST({e} AS VARCHAR)) AS VARCHAR), ':', CAST({e} AS VARCHAR), ';') END"
        for e in exprs
    ]
    return "concat(" + ", ".join(cells) + ")"


def digest(*exprs: str) -> str:
    return f"sha256({framed(*exprs)})"


def bag(rows: str, keys: str, member: str, version: str, out: str = "digest") -> str:
    """(keys, out, members) of the rows of a FROM item: the digest tree in one nested SELECT per level."""
    level = f"SELECT {keys}, {member} AS item, {member} AS head, 1 AS n FROM {rows} bag_rows WHERE {member} IS NOT NULL"
    for digits in (6, 3):
        level = (
            f"SELECT {keys}, substr(head, 1, {digits}) AS head, sha256(concat(substr(head, 1, {digits}), ':', string_agg(item, ',' ORDER BY item))) AS item, sum(n) AS n "
            f"FROM ({level}) below{digits} GROUP BY {keys}, substr(head, 1, {digits})"
        )
    return (
        f"SELECT {keys}, sha256(concat_ws('|', '{version}', CAST(CAST(sum(n) AS BIGINT) AS VARCHAR), string_agg(item, ',' ORDER BY item))) AS {out}, "
        f"CAST(sum(n) AS BIGINT) AS members FROM ({level}) root_of GROUP BY {keys}"
    )
