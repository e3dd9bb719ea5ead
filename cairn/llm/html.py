"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM, decoded by Viterbi."""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import in_batches

# Elements by their part in a page's layout, as the HTML standard has them. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
HIDDEN = frozenset("head script style title noscript iframe noembed noframes template svg math object canvas audio video map".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr "
    "html input label legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split()
)
#: What an opening tag closes, and the elements that shield it.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ENDS_P = BLOCK - frozenset("br button input label select option optgroup textarea tbody td tfoot th thead tr body head html caption legend".split())
SHIELDS_P = frozenset("button td th table caption html body object".split()) | frozenset("article aside blockquote div section main nav header footer form li dd fieldset figure".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>""", re.S)
#: The same for pages of broken quotes: a tag ends at the next ``>``.
_LOOSE = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_BEGINS = re.compile(r"<[!?/a-zA-Z]")
#: Tags with quotes that never close, after which quotes no longer count; open elements, beyond which none is opened (as in browsers).
MOST_BROKEN, MOST_DEPTH = 16, 512
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_TOKEN = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    path: tuple[tuple[str, str], ...]
    text: str
    linked: int


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page with text, in order: ancestors (tag, class and id tokens) and text with white space folded.

    The time is linear in the page, whatever stands in it: what is read again and again for broken quotes or open elements is bounded.
    """
    stack: list[tuple[str, str]] = []
    found: list[Block] = []
    runs: list[str] = []
    linked = hidden = anchors = at = 0

    def flush() -> None:
        nonlocal linked
        if runs:
            text = " ".join("".join(runs).split())
            if text:
                found.append(Block(tuple(stack), text, linked))
            runs.clear()
        linked = 0

    def said(raw: str) -> None:
        nonlocal linked
        if raw and not hidden:
            text = html.unescape(raw) if "&" in raw else raw
            runs.append(text)
            if anchors:
                linked += len(text)

    def pop_to(depth: int) -> None:
        nonlocal hidden, anchors
        while len(stack) > depth:
            tag = stack.pop()[0]
            hidden -= tag in HIDDEN
            anchors -= tag == "a"

    n, last, broken, told = len(page), page.rfind(">"), 0, 0
    while told < n:
        b = _BEGINS.search(page, at)
        start = b.start() if b else n
        if start > last:  # no tag ends any more; a comment may begin
            comment = page.find("<!--", start)
            said(page[told : comment if comment >= 0 else n])
            break
        m = (_TAG if broken < MOST_BROKEN else _LOOSE).match(page, start)
        if m is None:  # no tag: text
            broken += page[start + 1] not in "/!?" or page[start + 2 : start + 3].isalpha()
            at = start + 1
            continue
        said(page[told:start])
        at = told = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                flush()
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    if tag in BLOCK or not any(s[0] in SHIELDS_P for s in stack[depth + 1 :]):
                        pop_to(depth)
                    break
                if stack[depth][0] in ("td", "table") and tag not in ("td", "tr", "table", "tbody", "body", "html", "div", "article", "section", "main"):
                    break
            continue
        if tag in BLOCK:
            flush()
        if tag in ENDS_P:
            _close(stack, {"p"}, SHIELDS_P, pop_to)
        if tag in CLOSES:
            _close(stack, *CLOSES[tag], pop_to)
        if tag in VOID:
            continue
        if m[3].rstrip().endswith("/") and tag in ("svg", "path"):
            continue
        tokens = ""
        if "=" in m[3]:
            values = [a[2] or a[3] or a[4] or "" for a in _ATTR.finditer(m[3])]
            if values:
                tokens = " ".join(dict.fromkeys(_TOKEN.findall(_CAMEL.sub(" ", " ".join(values)).lower())))
        if len(stack) < MOST_DEPTH:
            stack.append((tag, tokens))
            hidden += tag in HIDDEN
            anchors += tag == "a"
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            stop = end.start() if end else n
            said(page[at:stop])
            at = told = stop
    flush()
    return found


def _close(stack, tags, shields, pop_to) -> None:
    for depth in range(len(stack) - 1, -1, -1):
        tag = stack[depth][0]
        if tag in tags:
            pop_to(depth)
            return
        if tag in shields:
            return


# Class names that pages give their parts. Fixed values.
MAIN_NAMES = "content main-content post-content entry-content article-body article-content story-body post-body article post entry story text body-text page-content single-post".split()
SIDE_NAMES = "sidebar side-bar aside related related-posts widget widget-area rail recommended most-read trending popular tags author-box secondary".split()
AD_NAMES = "ad ads advert advertisement ad-slot banner sponsored sponsor promo promotion ad-container adsbox dfp outbrain".split()
NOTICE_NAMES = "notice cookie-notice cookie-banner cookie consent gdpr alert message newsletter newsletter-signup popup modal subscribe paywall disclaimer announcement".split()
COMMENT_NAMES = "comments comment-list comment comment-body reader-comments discussion responses replies disqus feedback".split()
FOOT_NAMES = "footer site-footer page-footer copyright legal bottom colophon".split()
HEAD_NAMES = "header site-header masthead top-bar branding page-header logo tagline".split()
MENU_NAMES = "nav navbar menu main-menu navigation breadcrumb breadcrumbs pagination pager sub-nav share social share-buttons skip-link toc".split()
FORM_NAMES = "form search-form login contact-form signup search subscribe-form".split()

_OTHERS = frozenset(t for name in (*SIDE_NAMES, *AD_NAMES, *NOTICE_NAMES, *COMMENT_NAMES, *FORM_NAMES, *MENU_NAMES) for t in name.split("-")) - frozenset("content author body single list slot container box top".split())


def in_main(path: tuple[tuple[str, str], ...]) -> bool:
    """The label of a block on a training page, from what the page marks; no feature. Whether a block's ancestors have it in an article or main element, and in none of its adverts, comments, notices, forms, menus and asides."""
    for i, (t, _) in enumerate(path):
        if t in ("article", "main"):
            inner = path[i + 1 :]
            return not any(tag in ("aside", "nav", "footer", "form") or not _OTHERS.isdisjoint(names.split()) for tag, names in inner)
    return False


# Features ----------------------------------------------------------------------------------------

#: Elements of running text.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 b i em strong a span u small blockquote ul ol li pre q sub sup code".split())
_COMMON = frozenset("content author body single list slot container box top post story text page entry".split())
#: What a part is called by its class name: the lists of names above, word by word; features only, no label follows from them.
KINDS: dict[str, set[str]] = {}
for _kind, _names in (("side", SIDE_NAMES), ("ad", AD_NAMES), ("notice", NOTICE_NAMES), ("comment", COMMENT_NAMES), ("foot", FOOT_NAMES), ("head", HEAD_NAMES), ("menu", MENU_NAMES), ("form", FORM_NAMES)):
    for _word in {w for name in _names for w in name.split("-")} - _COMMON:
        KINDS.setdefault(_word, set()).add(_kind)


def path_features(path: tuple[tuple[str, str], ...]) -> list[str]:
    names = {f"in:{t}" for t, _ in path} | {f"tok:{w}" for _, ts in path for w in ts.split()}
    near = [p for p in path if p[0] in BLOCK][-3:]
    for i, (tag, tokens) in enumerate(reversed(near)):
        names.add(f"near{i}:{tag}")
        names.update(f"ntok:{w}" for w in tokens.split())
    names.add(f"depth:{min(len(path), 12)}")
    for i, (_, tokens) in enumerate(path):
        at = "own" if i == len(path) - 1 else "over"
        names |= {f"{at}:{k}" for w in tokens.split() for k in KINDS.get(w, ())}
    marked = [i for i, (tag, _) in enumerate(path) if tag in ("article", "main")]
    if marked:  # what stands between the outermost article and the block
        inner = path[marked[0] + 1 :]
        names |= {f"inner:{t}" for t, _ in inner} | {f"itok:{w}" for _, ts in inner for w in ts.split()}
        if not any(tokens for _, tokens in inner):
            names.add("unnamed:" + ("text" if all(tag in PROSE for tag, _ in inner) else "part"))
        names |= {f"inside:{k}" for _, ts in inner[:-1] for w in ts.split() for k in KINDS.get(w, ())}
    return sorted(names)


def text_features(block: Block) -> list[str]:
    text, n = block.text, len(block.text)
    words = text.count(" ") + 1
    names = [
        f"words:{min(words.bit_length(), 9)}",
        f"links:{min(4, 4 * block.linked // max(1, n))}",
        f"stop:{text.rstrip(' |·»')[-1:] in tuple('.!?:;…\"”')}",
        f"commas:{min(3, text.count(','))}",
        f"digits:{min(3, 8 * sum(map(text.count, '0123456789')) // n)}",
    ]
    if "©" in text or "(c)" in text:
        names.append("copyright")
    if "|" in text or "·" in text or "»" in text:
        names.append("bars")
    if text[0].islower():
        names.append("lower")
    return names


def place_features(i: int, n: int) -> list[str]:
    return [f"place:{min(9, 10 * i // n)}", *(["first"] if i == 0 else []), *(["last"] if i == n - 1 else [])]


def features(blocks: list[Block]) -> list[list[str]]:
    """Features of each block: ancestors, text, place, and the text features of its neighbours."""
    own = [text_features(b) for b in blocks]
    out = []
    for i, b in enumerate(blocks):
        names = path_features(b.path) + own[i] + place_features(i, len(blocks)) + ["bias"]
        names += [f"before:{x}" for x in own[i - 1][:2]] if i else ["before:none"]
        names += [f"after:{x}" for x in own[i + 1][:2]] if i + 1 < len(blocks) else ["after:none"]
        out.append(names)
    return out


# The model ---------------------------------------------------------------------------------------


@dataclass
class Crf:
    """Weights of features for label 1 (main text) against 0, and of transitions [from, to]."""

    weights: dict[str, float] = field(default_factory=dict)
    moves: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))

    def emission(self, names: list[str]) -> float:
        get = self.weights.get
        return sum(get(x, 0.0) for x in names)


def viterbi(emissions: list[float], moves) -> list[int]:
    """The best label sequence; of equal ones, that with the earlier 0."""
    if not emissions:
        return []
    back, a, b = [], 0.0, emissions[0]
    (m00, m01), (m10, m11) = moves
    for e in emissions[1:]:
        to0 = (a + m00, 0) if a + m00 >= b + m10 else (b + m10, 1)
        to1 = (a + m01, 0) if a + m01 >= b + m11 else (b + m11, 1)
        back.append((to0[1], to1[1]))
        a, b = to0[0], to1[0] + e
    label = 0 if a >= b else 1
    labels = [label]
    for step in reversed(back):
        label = step[label]
        labels.append(label)
    return labels[::-1]


def objective(x: np.ndarray, y: np.ndarray, spot: np.ndarray, w: np.ndarray, moves: np.ndarray, penalty: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The penalised negative log-likelihood of all pages and its gradients by ``w`` and ``moves``.

    ``x`` has a row of features per block and ``y`` its label; ``spot[page, t]`` is the row of a page's block number t, -1 beyond its
    end. Forward and backward passes step through all pages together.
    """
    there, (n, longest) = spot >= 0, spot.shape
    sizes, rows_at = there.sum(1), np.arange(n)
    labels = np.where(there, y[np.maximum(spot, 0)], 0)
    both = there[:, 1:]
    truth = np.zeros((2, 2))
    np.add.at(truth, (labels[:, :-1][both], labels[:, 1:][both]), 1)
    e = np.where(there, (x @ w)[np.maximum(spot, 0)].astype(float), 0.0)
    alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
    alpha[:, 0, 1] = e[:, 0]
    for t in range(1, longest):
        alpha[:, t] = np.logaddexp(alpha[:, t - 1, 0, None] + moves[0], alpha[:, t - 1, 1, None] + moves[1])
        alpha[:, t, 1] += e[:, t]
    for t in range(longest - 2, -1, -1):
        ahead = beta[:, t + 1].copy()
        ahead[:, 1] += e[:, t + 1]
        value = np.logaddexp(ahead[:, 0, None] + moves[:, 0], ahead[:, 1, None] + moves[:, 1])
        beta[:, t] = np.where(there[:, t + 1, None], value, 0.0)
    z = np.logaddexp(*alpha[rows_at, sizes - 1].T)
    error = np.zeros(len(y))
    error[spot[there]] = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None])[there] - y[spot[there]]
    expected = np.zeros((2, 2))
    for a in range(2):
        for b in range(2):
            joint = alpha[:, :-1, a] + moves[a, b] + beta[:, 1:, b] + (e[:, 1:] if b else 0.0) - z[:, None]
            expected[a, b] = np.exp(joint[both]).sum()
    loss = z.sum() - (e * labels).sum() - (truth * moves).sum() + penalty / 2 * (float(w @ w) + (moves * moves).sum())
    return loss, x.T @ error.astype(x.dtype) + penalty * w, expected - truth + penalty * moves


def fit(pages: list[tuple[list[list[str]], list[int]]], *, rounds: int = 160, penalty: float = 0.3, least: int = 4) -> Crf:
    """Maximum likelihood with an L2 penalty, by Adam over all pages at once, on features that occur ``least`` times or more."""
    pages = [p for p in pages if p[0]]
    if not pages:
        return Crf()
    seen = Counter(x for rows, _ in pages for r in rows for x in set(r))
    index = {x: i for i, x in enumerate(sorted(x for x, n in seen.items() if n >= least))}
    total, longest = sum(len(r) for r, _ in pages), max(len(r) for r, _ in pages)
    x = np.zeros((total, len(index)), np.float32)
    y = np.concatenate([np.array(labels) for _, labels in pages])
    row, spot = 0, np.full((len(pages), longest), -1)
    for p, (rows, _) in enumerate(pages):
        for t, names in enumerate(rows):
            x[row, [index[n] for n in names if n in index]] = 1
            spot[p, t] = row
            row += 1
    w, moves = np.zeros(len(index), np.float32), np.zeros((2, 2))
    state = [np.zeros(len(w) + 4), np.zeros(len(w) + 4)]
    for step in range(1, rounds + 1):
        _, by_w, by_moves = objective(x, y, spot, w, moves, penalty)
        gradient = np.concatenate([by_w, by_moves.ravel()])
        state[0] = 0.9 * state[0] + 0.1 * gradient
        state[1] = 0.99 * state[1] + 0.01 * gradient**2
        move = 0.12 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        w = (w - move[: len(w)]).astype(np.float32)
        moves = moves - move[len(w) :].reshape(2, 2)
    return Crf({n: float(w[i]) for n, i in index.items()}, tuple(map(tuple, moves.tolist())))


# Labelled pages ----------------------------------------------------------------------------------

def labelled_variants(page: str, strangers: list[str], seed: int, variants: int = 3, most_blocks: int = 80) -> list[tuple[list[list[str]], list[int]]]:
    """Labelled block sequences from a page that marks its article: as it is, and laid out anew in several ways.

    In the new layouts the article's own blocks are the main text and everything else is known not to be:
    menus, headers, footers, sidebars, notices, adverts, forms and comments, some of them inside the
    article, with varied or no class names; in most layouts the article's own tags and names are hidden, and parts of it may carry names that
    elsewhere mark comments or forms. Texts of the other parts come from ``strangers``.
    """
    own = blocks_of(page)
    labels = [in_main(b.path) for b in own]
    main, rest = ([b for b, label in zip(own, labels, strict=True) if label is side] for side in (True, False))
    if not main or len(own) > most_blocks:
        return []
    out = [(features(own), list(map(int, labels)))]
    rng = random.Random(seed)
    texts = [b.text for b in rest] + strangers
    for _ in range(variants):
        out.append(_laid_out(rng, [(b.path[-1][0] if b.path else "p", b.text) for b in main], texts))
    return out


def _laid_out(rng: random.Random, main: list[tuple[str, str]], strangers: list[str]):
    marker = "\x01"
    text_of = lambda: html.escape(rng.choice(strangers)) if strangers else "x"
    bit = lambda k: " ".join(text_of().split()[:k])

    def attr(names, chance=0.75):
        if rng.random() > chance:
            return ""
        return f' {rng.choice(("class", "class", "id"))}="{rng.choice(names)}"'

    def part(tags, names, body):
        tag = rng.choice(tags)
        plain = tag in ("div", "section", "ul", "p")
        return f"<{tag}{attr(names, 1.0 if plain else 0.5)}>{body}</{tag}>"

    def menu():
        items = "".join(f'<li><a href="#">{bit(rng.randint(1, 4))}</a></li>' for _ in range(rng.randint(2, 6)))
        return part(["nav", "nav", "div", "ul"], MENU_NAMES, f"<ul>{items}</ul>" if rng.random() < 0.7 else "".join(f'<a href="#">{bit(2)}</a> ' for _ in range(4)))

    def head():
        return part(["header", "div"], HEAD_NAMES, rng.choice([f"<h1>{bit(4)}</h1>", f"<p>{bit(6)}</p>", f"<div>{bit(3)}</div>" + menu(), f"<a href='/'>{bit(3)}</a>"]))

    def side():
        body = rng.choice([f"<h3>{bit(3)}</h3><p>{text_of()}</p>", f"<ul><li><a href='#'>{bit(8)}</a></li><li><a href='#'>{bit(7)}</a></li></ul>", f"<p>{text_of()}</p><p>{text_of()}</p>", text_of()])
        return part(["aside", "aside", "div", "section"], SIDE_NAMES, body)

    def ad():
        return part(["div", "div", "section", "aside", "p", "ins"], AD_NAMES, rng.choice([text_of(), f"<p>{text_of()}</p>", f"<a href='#'>{bit(6)}</a>"]))

    def notice():
        return part(["div", "div", "section", "p", "dialog"], NOTICE_NAMES, rng.choice([text_of(), f"<p>{text_of()}</p><button>{bit(2)}</button>"]))

    def comments():
        one = lambda: part(["div", "li", "article"], COMMENT_NAMES, rng.choice([f"<p>{text_of()}</p>", f"<b>{bit(2)}</b><p>{text_of()}</p><p>{text_of()}</p>", text_of()]))
        return part(["section", "div", "div", "ol"], COMMENT_NAMES, rng.choice(["", f"<h2>{bit(2)}</h2>"]) + "".join(one() for _ in range(rng.randint(1, 4))))

    def form():
        return f"<form{attr(FORM_NAMES, 0.5)}><label>{bit(3)}</label><input>" + rng.choice(["", f"<p>{text_of()}</p>", f"<select><option>{bit(1)}</option><option>{bit(1)}</option></select>"]) + f"<button>{bit(2)}</button></form>"

    def foot():
        return part(["footer", "footer", "div"], FOOT_NAMES, rng.choice([f"&copy; {text_of()}", f"<p>{text_of()}</p>", f"<p>&copy; {bit(8)}</p>" + menu()]))

    inside = [ad, ad, side, notice, form, comments, menu]
    odd = [*COMMENT_NAMES, *FORM_NAMES, *SIDE_NAMES, *NOTICE_NAMES]
    hidden = rng.random() < 0.5  # neither tags nor names tell the article
    pieces = []
    for i, (tag, text) in enumerate(main):
        tag = tag if tag in ("p", "h1", "h2", "h3", "li", "blockquote", "td", "pre", "figcaption") else "p"
        if tag == "p" and i and rng.random() < 0.12:
            tag = rng.choice(["h2", "h3", "li", "blockquote", "figcaption", "div"])
        given = attr([*MAIN_NAMES, "lead", "paragraph", "intro"], 0.6) if rng.random() < 0.15 else attr(odd, 1.0) if rng.random() < 0.06 else ""
        if rng.random() < 0.04:  # a word or two by themselves
            text = " ".join(text.split()[: rng.randint(1, 2)])
        half, draw = len(text) // 2, rng.random()
        if draw < 0.05:
            inner = f"{html.escape(text[:half])}<a href='#'>{html.escape(text[half:])}</a>"
        elif draw < 0.15:
            bold = rng.choice(["b", "strong", "em", "i"])
            inner = f"<{bold}>{marker}{html.escape(text)}</{bold}>" if draw < 0.09 else f"<{bold}>{html.escape(text[:half])}</{bold}>{html.escape(text[half:])}"
        else:
            inner = html.escape(text)
        pieces.append(f"<{tag}{given}>{marker}{inner}</{tag}>")
        if rng.random() < 0.07:
            pieces.append(rng.choice(inside)())
    if rng.random() < 0.3:
        pieces.append(rng.choice([comments, side, form])())
    shape = rng.random()
    if hidden:
        tag = rng.choice(["div", "div", "section", "td"])
        body = f"<{tag}>{''.join(pieces)}</{tag}>" if tag != "td" else f"<table><tr><td>{''.join(pieces)}</td></tr></table>"
    elif shape < 0.45:
        body = f"<article{attr(MAIN_NAMES, 0.4)}>{''.join(pieces)}</article>"
    elif shape < 0.6:
        body = f"<main{attr(MAIN_NAMES, 0.4)}>{''.join(pieces)}</main>"
    elif shape < 0.7:
        body = f"<main><article>{''.join(pieces)}</article></main>"
    else:
        tag = rng.choice(["div", "div", "section"])
        body = f"<{tag}{attr(MAIN_NAMES, 0.95)}>{''.join(pieces)}</{tag}>"
    before = [f() for f in (menu, head, notice, ad, form, side) if rng.random() < 0.4]
    after = [f() for f in (side, comments, ad, form, notice, menu, foot, foot) if rng.random() < 0.4]
    rng.shuffle(before)
    page = f"<html><body>{''.join(before)}{body}{''.join(after)}</body></html>"
    blocks = blocks_of(page)
    labels = [int(marker in b.text) for b in blocks]
    for b in blocks:
        b.text = b.text.replace(marker, "") or "x"
    return features(blocks), labels


def learn(pages: DataFrame, *, sample: int = 240, longest: int = 30_000, most_blocks: int = 80, seed: int = 11) -> Crf:
    """A field fitted on at most ``sample`` pages that mark their article, of at most ``longest`` characters and ``most_blocks`` blocks, chosen by a hash of the id."""
    marked = pages.select("page_id", F.col("html").cast("string").alias("html")).where(F.col("page_id").isNotNull() & (F.length("html") <= longest)).where(F.col("html").rlike("(?i)<(article|main)[ >]"))
    marked = marked.withColumn("h", F.xxhash64("html"))
    # ids first: what the tasks send to the driver are ids, and then the chosen pages alone
    chosen = marked.select("page_id", "h").distinct().orderBy(F.xxhash64("page_id"), "page_id", "h").limit(sample)
    found = marked.join(F.broadcast(chosen), ["page_id", "h"]).select(F.xxhash64("page_id").alias("o"), "page_id", "h", "html").distinct().collect()  # at most sample * longest characters
    rows = sorted(found, key=lambda r: (r["o"], r["page_id"], r["h"]))
    pool = [b.text for r in rows for b in blocks_of(r["html"]) if not in_main(b.path)]
    prose = [b.text for r in rows for b in blocks_of(r["html"]) if len(b.text) < 400]
    data = []
    for i, r in enumerate(rows):
        rng = random.Random(seed * 1000 + i)
        strangers = [rng.choice(pool) for _ in range(12)] + [rng.choice(prose) for _ in range(8)] if pool and prose else []
        data += labelled_variants(r["html"], strangers, seed + i, most_blocks=most_blocks)
    return fit(data)


def main_text(page: str, model: Crf, cache: dict) -> str:
    blocks = blocks_of(page)
    n = len(blocks)
    own = [text_features(b) for b in blocks]
    emissions, get = [], model.weights.get
    for i, b in enumerate(blocks):
        score = cache.get(b.path)
        if score is None:
            if len(cache) > 20_000:
                cache.clear()
            score = cache[b.path] = model.emission(path_features(b.path)) + get("bias", 0.0)
        score += model.emission(own[i]) + model.emission(place_features(i, n))
        score += sum(get(f"before:{x}", 0.0) for x in own[i - 1][:2]) if i else get("before:none", 0.0)
        score += sum(get(f"after:{x}", 0.0) for x in own[i + 1][:2]) if i + 1 < n else get("after:none", 0.0)
        emissions.append(score)
    return " ".join(b.text for b, label in zip(blocks, viterbi(emissions, model.moves), strict=True) if label)


def extract(pages: DataFrame, model: Crf) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page, one row per input row.

    Null html counts as empty; a page without main text has an empty text; with a model that has learned
    nothing, every text is empty; an empty table gives no rows. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            texts = [main_text(h, model, cache) if h else "" for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = in_batches(pages).select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
