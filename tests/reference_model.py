"""Plain models the plans are compared with: SQLite full-text search and a loop parser."""

import re
import sqlite3

JS_SPACE = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def parse(raw, prefix_last=False):
    """Search string -> (filters, clauses); a clause is (negated, title_only, prefix, text)."""
    tokens = []
    for i, segment in enumerate(raw.split('"')):
        if i % 2 == 0:
            tokens += [(w, True) for w in re.split(f"[{JS_SPACE}]+", segment) if w]
        elif segment:
            tokens.append((segment, i == raw.count('"')))
    filters, clauses = {}, []
    for text, is_open in tokens:
        key, colon, value = text.partition(":")
        key = key.lower()
        if is_open and colon and key and value:
            if key == "title":
                clauses.append([False, True, False, value, False])
                continue
            if key == "tag":
                filters["tag"] = value
                continue
            if key in ("before", "after") and re.fullmatch(r"[0-9]{4}(-[0-9]{2}){0,2}", value):
                filters[key] = value + "-01" * ((10 - len(value)) // 3)
                continue
            if key == "status" and value.lower() in ("published", "draft", "scheduled", "sent"):
                filters[key] = value.lower()
                continue
            if key == "type" and value.lower() in ("post", "page"):
                filters[key] = value.lower()
                continue
        if is_open and text.startswith("-") and len(text) > 1:
            clauses.append([True, False, False, text[1:], False])
        else:
            clauses.append([False, False, False, text, is_open])
    positive = [c for c in clauses if not c[0]]
    if not positive:
        return filters, []
    if prefix_last and positive[-1][4]:
        positive[-1][2] = True
    return filters, [tuple(c[:4]) for c in clauses]


def fts_archive(documents):
    """The documents (rows with the model's columns) in an in-memory SQLite archive."""
    db = sqlite3.connect(":memory:")
    db.execute(
        "create table d(n integer primary key, id, type, status, title, plaintext, tags, published_at, updated_at)"
    )
    db.execute(
        "create virtual table t using fts5(title, plaintext, tags, content='d', content_rowid='n', tokenize='porter unicode61')"
    )
    db.executemany(
        "insert into d values(?,?,?,?,?,?,?,?,?)",
        [
            (n, r["id"], r["type"], r["status"], r["title"], r["plaintext"], ",".join(r["tags"]), r["published_at"], r["updated_at"])
            for n, r in enumerate(documents, 1)
        ],
    )
    db.execute("insert into t(t) values('rebuild')")
    return db


def fts_search(db, raw, prefix_last=False, limit=50):
    """[(id, score, snippet)] in order, ties by id."""
    filters, clauses = parse(raw, prefix_last)
    where, values = "1=1", []
    for name, rule in (
        ("tag", "',' || d.tags || ',' like '%,' || ? || ',%'"),
        ("status", "d.status = ?"),
        ("type", "d.type = ?"),
        ("after", "d.published_at >= ?"),
        ("before", "d.published_at < ?"),
    ):
        if name in filters:
            where += f" and {rule}"
            values.append(filters[name])
    if not clauses:
        sql = f"select id, 0.0, substr(plaintext, 1, 160) from d where {where} order by published_at desc, updated_at desc, id limit ?"
        return db.execute(sql, [*values, limit]).fetchall()
    quoted = lambda c: ("title:" if c[1] else "") + '"' + c[3].replace('"', '""') + '"' + ("*" if c[2] else "")
    match = " AND ".join(quoted(c) for c in clauses if not c[0])
    match += "".join(f" NOT {quoted(c)}" for c in clauses if c[0])
    sql = (
        "select d.id, bm25(t, 10.0, 1.0, 3.0) as score, snippet(t, 1, '[', ']', '…', 12) "
        f"from t join d on d.n = t.rowid where t match ? and {where} order by score, d.id limit ?"
    )
    return db.execute(sql, [match, *values, limit]).fetchall()
