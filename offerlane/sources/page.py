"""A parser of pages into texts and elements, and links made absolute."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
AMOUNT = re.compile(r"[0-9][.,][0-9]{2}\b|[€$£]")


class Page(HTMLParser):
    """Elements of a page as spans over the list of its texts."""

    def __init__(self):
        super().__init__()
        self.words, self.nodes, self.open, self.raw = [], [], [], None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        node = {"tag": tag, "a": a, "up": self.open[-1] if self.open else None, "from": len(self.words), "to": None}
        self.nodes.append(node)
        if tag in _VOID:
            node["to"] = len(self.words)
        else:
            self.open.append(len(self.nodes) - 1)
            if tag in ("script", "style"):
                self.raw = []

    def handle_endtag(self, tag):
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.nodes[self.open[k]]["tag"] == tag), None)
        if at is None:
            return
        for k in self.open[at:]:
            self.nodes[k]["to"] = len(self.words)
        if self.raw is not None:
            self.nodes[self.open[at]]["raw"], self.raw = "".join(self.raw), None
        del self.open[at:]

    def handle_data(self, data):
        if self.raw is not None:
            self.raw.append(data)
        elif data.strip():
            self.words.append(" ".join(data.split()))

    def text(self, node) -> str:
        return " ".join(self.words[node["from"] : len(self.words) if node["to"] is None else node["to"]])

    def extend(self) -> None:
        """Gives each element the number of the last element within it."""
        for k, n in enumerate(self.nodes):
            n["last"] = k
        for k in range(len(self.nodes) - 1, -1, -1):
            up = self.nodes[k]["up"]
            if up is not None:
                self.nodes[up]["last"] = max(self.nodes[up]["last"], self.nodes[k]["last"])


def absolute(url: Column, base: Column) -> Column:
    """A link made absolute against the URL of its page."""
    host = F.regexp_extract(base, r"^([A-Za-z]+://[^/?#]+)", 1)
    folder = F.regexp_replace(F.substring_index(F.substring_index(base, "#", 1), "?", 1), "(?<=[^/])/[^/]*$", "")
    return (
        F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), url).when(url.startswith("//"), F.concat(F.regexp_extract(base, "^([A-Za-z]+:)", 1), url))
        .when(url.startswith("/"), F.concat(host, url)).otherwise(F.concat(folder, F.lit("/"), url))
    )
