"""Providers for test_providers: pages of numbered items."""

PAGES = {"a": 3, "b": 2, "long": 50}


def fetch(provider, cursor):
    page = int(cursor or 0)
    if provider == "broken" and page == 1:
        raise ConnectionError("no answer")
    if provider == "loop":
        return [{"id": f"loop{page}"}], "1"
    if provider == "empty":
        return [], None
    items = [{"id": f"{provider}{page}-{k}", "title": f"t{k}"} for k in range(4)] + [{"id": f"{provider}0-0", "title": "again"}]
    last = PAGES.get(provider, 3) - 1
    return items, None if page >= last else str(page + 1)
