"""Main text of pages by a linear-chain conditional random field over leaf blocks.

Each leaf block of a page is labelled main text or not. A block's features are its ancestors' tags, the meanings of
their class, id and role values, and the look of its text; neighbouring labels are tied by transition weights. The
field is trained on labelled pages by the gradient of its log-likelihood (forward-backward), and a page is labelled by
Viterbi, block scores being sums of the weights of the block's features.

The labelled pages are made by `labelled_pages`: page layouts as they are in use, in semantic tags or in named
boxes, with menus, headers, footers, sidebars, notices, adverts, forms and reader comments round and inside of the
article. Their number is the bound of the fit and doesn't depend on the input. Any other labelled pages can be given.

Pages are read whole, one at a time, and are not shuffled. Null and empty pages, and pages without main text, give an
empty text. Repeated rows are extracted one by one. Columns with other names are not looked at.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm.html_blocks import blocks, features

PAGES = 500
MARK = "⁣"  # at the start of a text in a labelled page: this block is main text


@dataclass
class Field:
    weights: dict[str, float]  # for main text against not
    start: float
    step: tuple[tuple[float, float], tuple[float, float]]  # [label before][label]

    def scores(self, rows: list[list[str]]) -> list[float]:
        get = self.weights.get
        return [sum(get(f, 0.0) for f in row) for row in rows]

    def labels(self, rows: list[list[str]]) -> list[int]:
        """The likeliest labels (Viterbi)."""
        s = self.scores(rows)
        if not s:
            return []
        (t00, t01), (t10, t11) = self.step
        a, b = 0.0, s[0] + self.start
        back = []
        for x in s[1:]:
            a0, b0, a1, b1 = a + t00, b + t10, a + t01 + x, b + t11 + x
            back.append((b0 > a0, b1 > a1))
            a, b = max(a0, b0), max(a1, b1)
        y = int(b > a)
        out = [y]
        for from0, from1 in reversed(back):
            y = int(from1 if y else from0)
            out.append(y)
        return out[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], epochs: int = 40, shrink: float = 2e-3) -> Field:
    """pages: features and labels (1 for main text) of each page's blocks. Adagrad over whole pages."""
    names = sorted({f for rows, _ in pages for row in rows for f in row})
    index = {f: i for i, f in enumerate(names)}
    w, g = np.zeros(len(names)), np.ones(len(names))
    t, gt = np.zeros(5), np.ones(5)  # start, then step by (before, after)
    data = []
    for rows, labels in pages:
        if rows:
            flat = np.array([index[f] for row in rows for f in row])
            data.append((flat, np.array([len(r) for r in rows]), np.array(labels, dtype=float)))
    order = random.Random(2)
    for _ in range(epochs):
        order.shuffle(data)
        for flat, sizes, y in data:
            row = np.repeat(np.arange(len(sizes)), sizes)
            s = np.bincount(row, weights=w[flat], minlength=len(sizes)).tolist()
            p, pairs = _marginals(s, t)
            miss = p - y
            dw = np.bincount(flat, weights=miss[row], minlength=len(w)) + shrink * w
            before, after = y[:-1].astype(int), y[1:].astype(int)
            dt = np.concatenate([[miss[0]], pairs - np.bincount(2 * before + after, minlength=4)]) + shrink * t
            g, gt = g + dw**2, gt + dt**2
            w -= 0.4 * dw / np.sqrt(g)
            t -= 0.1 * dt / np.sqrt(gt)
    start, t00, t01, t10, t11 = t.tolist()
    return Field(dict(zip(names, w.tolist(), strict=True)), start, ((t00, t01), (t10, t11)))


def _marginals(s: list[float], t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(label 1) of each block and the expected number of each pair of neighbouring labels (forward-backward)."""
    n = len(s)
    step = np.exp(np.clip(t[1:], -20, 20)).tolist()
    e = [exp(max(-20.0, min(20.0, x))) for x in s]
    e[0] *= exp(max(-20.0, min(20.0, t[0])))
    f0, f1 = [0.0] * n, [0.0] * n
    b0, b1 = [1.0] * n, [1.0] * n
    f0[0], f1[0] = 1 / (1 + e[0]), e[0] / (1 + e[0])
    for k in range(1, n):
        x, y = f0[k - 1] * step[0] + f1[k - 1] * step[2], (f0[k - 1] * step[1] + f1[k - 1] * step[3]) * e[k]
        f0[k], f1[k] = x / (x + y), y / (x + y)
    for k in range(n - 2, -1, -1):
        x = step[0] * b0[k + 1] + step[1] * e[k + 1] * b1[k + 1]
        y = step[2] * b0[k + 1] + step[3] * e[k + 1] * b1[k + 1]
        b0[k], b1[k] = x / (x + y), y / (x + y)
    p = np.array([f1[k] * b1[k] / (f0[k] * b0[k] + f1[k] * b1[k]) for k in range(n)])
    pairs = np.zeros(4)
    for k in range(1, n):
        z = [
            f0[k - 1] * step[0] * b0[k], f0[k - 1] * step[1] * e[k] * b1[k],
            f1[k - 1] * step[2] * b0[k], f1[k - 1] * step[3] * e[k] * b1[k],
        ]
        pairs += np.array(z) / sum(z)
    return p, pairs


# Labelled pages ------------------------------------------------------------------------------------------------------


def labelled_pages(n: int = PAGES, seed: int = 4) -> list[tuple[list[list[str]], list[int]]]:
    """Features and labels of made pages; a block whose text begins with MARK is main text."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        found = blocks(_page(r))
        labels = [int(b.text.startswith(MARK)) for b in found]
        for b in found:
            b.text = b.text.removeprefix(MARK)
        out.append((features(found), labels))
    return out


def _words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice("aeiourstlnmdp") for _ in range(r.randint(1, 9))) for _ in range(n))


def _sentences(r: random.Random, most: int) -> str:
    """Mostly running text; now and then a single word or a list of words."""
    n = r.choice([1, 1, 2, r.randint(1, 12), r.randint(1, most)])
    return " ".join(_words(r, r.choice([1, 2, r.randint(3, 25)])).capitalize() + r.choice([".", ".", ".", "!", ",", ""]) for _ in range(n))


def _attr(r: random.Random, *names: str) -> str:
    name = r.choice(names)
    form = r.choice([name, f"site-{name}", f"{name}-box", f"{name}_1", f"x {name}"])
    return r.choice([f' class="{form}"', f' id="{form}"', f" class='{form} wide'"])


def _menu(r: random.Random) -> str:
    items = "".join(f'<li><a href="/{_words(r, 1)}">{_words(r, r.choice([1, 1, 2]))}</a></li>' for _ in range(r.randint(2, 9)))
    box = r.choice(["nav", "nav", "div"])
    return f"<{box}{_attr(r, 'menu', 'nav', 'breadcrumb') if box == 'div' or r.random() < 0.3 else ''}><ul>{items}</ul></{box}>"


def _box(r: random.Random, tags: list[str], names: list[str], inner: str) -> str:
    """inner in an element of a telling tag, or else in a box with a telling name."""
    tag = r.choice([*tags, "div"])
    return f"<{tag}{_attr(r, *names) if tag in ('div', 'section', 'ul') or r.random() < 0.4 else ''}>{inner}</{tag}>"


def _other(r: random.Random) -> str:
    """Something on a page that isn't main text."""
    text = lambda most=3: r.choice([f"<p>{_sentences(r, most)}</p>", _sentences(r, most), f"<div>{_sentences(r, most)}</div>"])
    kind = r.randrange(8)
    if kind == 0:
        return _menu(r)
    if kind == 1:
        return _box(r, ["div", "aside"], ["ad", "ads", "advert", "sponsored", "banner", "promo"], text())
    if kind == 2:
        links = "".join(f"<li><a href='#'>{_words(r, r.randint(2, 9))}</a></li>" for _ in range(r.randint(1, 6)))
        return _box(r, ["aside"], ["sidebar", "related", "widget", "popular"], f"<h3>{_words(r, 2)}</h3>" + r.choice([text(), f"<ul>{links}</ul>"]))
    if kind == 3:
        return _box(r, ["div"], ["cookie", "notice", "newsletter", "consent", "alert", "popup"], text() + r.choice(["", "<button>OK</button>"]))
    if kind == 4:
        fields = f"<label>{_words(r, 2)}</label><input><button>{_words(r, 1)}</button>" + r.choice(["", f"<select><option>{_words(r, 1)}<option>{_words(r, 1)}</select>", text(1)])
        return _box(r, ["form"], ["form", "search", "login"], f"<form>{fields}</form>" if r.random() < 0.5 else fields)
    if kind == 5:
        notes = "".join(f"<{r.choice(['div', 'li', 'article'])}{_attr(r, 'comment', 'reply')}>{r.choice(['', _words(r, 2)])}<p>{_sentences(r, 6)}</p></div>" for _ in range(r.randint(1, 5)))
        return _box(r, ["section"], ["comments", "responses", "disqus"], f"<h2>{_words(r, 2)}</h2>{notes}").replace("</div></section>", "</section>")
    if kind == 6:
        return _box(r, ["header"], ["header", "masthead", "logo"], r.choice([_words(r, 3), f"<h1>{_words(r, 2)}</h1>", f"<a href='/'>{_words(r, 2)}</a><p>{_words(r, 5)}</p>"]))
    return _box(r, ["div"], ["share", "social", "tags"], " ".join(f"<a href='#'>{_words(r, 1)}</a>" for _ in range(r.randint(1, 5))))


def _article(r: random.Random) -> str:
    parts = [f"<h1>{MARK}{_sentences(r, 2)}</h1>"] if r.random() < 0.85 else []
    for _ in range(r.choice([0, 1, 2, r.randint(2, 14)])):
        text = MARK + _sentences(r, 40)
        kind = r.random()
        if kind < 0.7:
            parts.append(f"<p>{r.choice(['', '<b>', '<i>'])}{text}{r.choice(['</p>', '<br>', '', '</b></p>'])}")
        elif kind < 0.78:
            parts.append(f"<{(h := r.choice(['h2', 'h3', 'h4']))}>{MARK}{_words(r, r.randint(1, 8))}</{h}>")
        elif kind < 0.86:
            parts.append("<ul>" + "".join(f"<li>{MARK}{_sentences(r, 3)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
        elif kind < 0.9:
            parts.append(f"<blockquote>{r.choice(['', '<p>'])}{text}</blockquote>")
        elif kind < 0.93:
            parts.append(f"<table><tr><td>{MARK}{_words(r, 2)}</td><td>{MARK}{_words(r, 1)}</td></tr></table>")
        elif kind < 0.96:
            parts.append(f"<pre>{text}</pre>")
        else:
            parts.append(_other(r))
    inner = "".join(parts) or f"<p>{MARK}{_sentences(r, 5)}</p>"
    style = r.random()
    if style < 0.5:
        return f"<article{_attr(r, 'post', 'entry') if r.random() < 0.3 else ''}>{inner}</article>"
    if style < 0.65:
        return f"<main>{r.choice(['', '<div>'])}{inner}</main>"
    if style < 0.9:
        return f"<div{_attr(r, 'content', 'article', 'post', 'entry', 'story', 'main')}>{inner}</div>"
    return f"<div>{inner}</div>"


def _page(r: random.Random) -> str:
    title = f"<head><title>{_words(r, r.randint(1, 10))}</title><style>p{{}}</style><script>var a='</p>';</script></head>" if r.random() < 0.9 else ""
    before = "".join(_other(r) for _ in range(r.randint(0, 4)))
    after = "".join(_other(r) for _ in range(r.randint(0, 4)))
    foot = _box(r, ["footer", "footer"], ["footer", "copyright", "bottom"], r.choice(["&copy; ", "", "&copy; " + _words(r, 1) + " &middot; "]) + r.choice([_words(r, 3), _sentences(r, 3), f"<p>{_words(r, 5)}</p>"])) if r.random() < 0.9 else ""
    body = before + _article(r) + after
    if r.random() < 0.3:
        body = f"<div{_attr(r, 'page', 'wrapper', 'container')}>{body}</div>"
    return f"<!DOCTYPE html><html>{title}<body>{body}{foot}</body></html>"


# Extraction ----------------------------------------------------------------------------------------------------------


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page)
    return " ".join(b.text for b, y in zip(found, field.labels(features(found)), strict=True) if y)


def extract(pages: DataFrame, field: Field, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per page: id, the columns to keep (but for the id and `text`, which is the result), text."""
    shared = pages.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), shared.value) for x in batch.column(batch.num_columns - 1)]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], [*batch.schema.names[:-1], "text"])

    names = [id_col, *(c for c in dict.fromkeys(keep) if c not in (id_col, "text"))]
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in names)
    return pages.select(*names, F.col(html_col).alias("_html")).mapInArrow(run, f"{kinds}, text string")
