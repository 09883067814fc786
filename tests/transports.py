"""A stand-in for the network: it serves the html of a ``pages`` table by page id, and troubles of all kinds."""

import pyarrow.parquet as pq

from tonewise.sources.fetch import AGENTS


def from_pages(options):
    table = pq.read_table(options["table"])
    html = dict(zip(map(str, table.column("page_id").to_pylist()), table.column("html").to_pylist(), strict=True))

    def get(url, headers, timeout):
        name, tried = url.rsplit("/", 1)[1], AGENTS.index(headers["User-Agent"])
        kind = int(name) % 6 if name.isdigit() else 4
        if kind == 1 and tried == 0:
            return 429, "slow down"
        if kind == 2:
            return 503, ""
        if kind == 3 and tried < 2:
            raise OSError("reset")
        if kind == 4:
            return 404, ""
        if kind == 5:
            raise OSError("unreachable")
        return 200, html[name]

    return get
