"""Tags of HTML pages, read in time that grows with the page alone, however broken it is."""

from __future__ import annotations

import re

TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
END = re.compile(r"[>\"']")


class Reader:
    """The tags of a page, in order. Every character is passed a bounded number of times, whatever is left open."""

    def __init__(self, page: str) -> None:
        self.page, self.last = page, page.rfind(">")
        self.hopeless: set[int] = set()  # quotes from which no tag ends

    def tag(self, at: int) -> tuple[int, int, str, str] | None:
        """(where it begins and ends, its name with a slash if it ends an element, attributes) of the next tag; the name is empty for comments and declarations."""
        page = self.page
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return at, len(page) if end < 0 else end + 3, "", ""
            if page[at + 1 : at + 2] in ("!", "?"):
                end = page.find(">", at + 2)
                return at, len(page) if end < 0 else end + 1, "", ""
            m = TAG.match(page, at) if at < self.last else None
            if m and m.end() <= self.last:
                end = self._end(m.end())
                return at, end + 1, ("/" if page[at + 1] == "/" else "") + m[1].lower(), page[m.end() : end]
            at += 1
        return None

    def _end(self, at: int) -> int:
        """The first > outside quotes, or the first at all where a quote is never closed."""
        page, first, seen = self.page, at, []
        while (m := END.search(page, at)) is not None:
            if m[0] == ">":
                return m.start()
            if m.start() in self.hopeless:
                break
            seen.append(m.start())
            close = page.find(m[0], m.end())
            if close < 0:
                break
            at = close + 1
        self.hopeless.update(seen)
        return page.find(">", first)

    def after(self, tag: str, at: int) -> int:
        """Behind the end tag of an element whose content is no text."""
        m = re.compile(rf"</{tag}\b", re.I).search(self.page, at)
        end = self.page.find(">", m.end()) if m else -1
        return len(self.page) if end < 0 else end + 1
