"""Offline page functions for the provider data sources."""


def oqmd(options, start, count):
    records = [{"formationenergy_id": i, "entry_id": i * 10, "name": f"M{i}", "composition": f"M{i}"} for i in range(8, 12)]
    bad = int(options.get("bad", -1))
    wanted = [r for r in records if start <= r["formationenergy_id"] < start + count]
    if any(r["formationenergy_id"] == bad for r in wanted):
        raise RuntimeError("server error")
    return wanted


def works(options, query, cursor, count):
    page = 0 if cursor == "*" else int(cursor)
    if query == "broken" and page == 1:
        raise RuntimeError("gone")
    found = [{"id": f"{query}-{page * count + i}", "title": query} for i in range(count)]
    return found, str(page + 1) if page < 2 else None


def tei(content):
    return "<TEI><text/></TEI>"


def no_tei(content):
    return "<html/>"


def logged_works(options, query, cursor, count):
    """Pages of a fixed catalogue: `shared` works come back under several queries."""
    import os
    import uuid

    page = 0 if cursor == "*" else int(cursor)
    with open(os.path.join(options["log"], f"{query}-{page}-{uuid.uuid4().hex}"), "w"):
        pass
    if query == "broken" and page == 1:
        raise RuntimeError("gone")
    if query == "empty":
        return [], None
    name = "a" if query == "same" else query
    found = [{"id": f"{name}-{page * 100 + i}", "doi": f"https://doi.org/10.1/{name}{page * 100 + i}", "title": query} for i in range(count)]
    return found, str(page + 1) if page < 3 else None


def unpaywall(options, doi):
    if doi.endswith("a1"):
        raise RuntimeError("not found")
    return {"doi": doi, "is_oa": True}


def linked_page(options, url):
    """Page n of a site, linked to its file and to page n + 1; pages that end in `bad` fail."""
    if url.endswith(options["bad"]):
        raise RuntimeError("no answer")
    number = int(url.rsplit("/", 1)[-1])
    return f'<a href="/f/{number}.pdf">file</a> <a href="/page/{number + 1}">next</a>'
