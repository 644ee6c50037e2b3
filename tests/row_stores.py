"""Row connectors for tests, in a module that tasks can import."""

from offerlane.sources.connectors import row_connector


def _rows(store, attempt):
    return [{"name": f"{store} {attempt} {k}", "price": "9,50", "available": k == 0} for k in range(3)]


@row_connector("Rows One")
def one(attempt):
    return _rows("rows one", attempt)


@row_connector("rows two")
def two(attempt):
    return _rows("rows two", attempt)
