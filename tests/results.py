"""Rows of both engines in one form."""


def plain(value):
    """Values as both engines agree on them."""
    if isinstance(value, float):
        return "nan" if value != value else round(value, 6)
    if value is None or isinstance(value, bool):
        return value
    return int(value) if isinstance(value, int) else str(value)


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(v) for v in r) for r in df.select(*names).collect()), key=repr)


def rows_of_sql(con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = [names.index(n) for n in sorted(names)]
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)
