"""DOM trees of pages, and labelled pages to train on."""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass, field

#: Elements inside a line of text, formulas among them; all others part blocks.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mspace mpadded mphantom menclose mtable mtr mtd semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, and none of which is text of the page.
RAW = frozenset("script style textarea title noscript template iframe xmp svg annotation annotation-xml".split())
#: Controls, whose text is part of a form; what begins or ends next after the start tag of one.
CONTROLS = {
    "button": re.compile(r"<(/?)button(?=[\s/>])", re.I),
    "select": re.compile(r"<(/?)select(?=[\s/>])", re.I),
    "option": re.compile(r"<(?:(/)option|option|/select|/datalist|/optgroup|optgroup)(?=[\s/>])", re.I),
}
#: Opening one of these ends an open p.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: An open element of the first kind ends where a new one opens, unless one of the second kind opened in between.
SELF_NESTED = {
    "li": (("li",), ("ul", "ol", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
}

START = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
QUOTED = re.compile(r"=\s*([\"'])")
ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Tree:
    """Block elements in document order; a parent comes before its children. Element 0 is the page."""

    tags: list[str] = field(default_factory=lambda: ["#page"])
    names: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    parents: list[int] = field(default_factory=lambda: [-1])
    depths: list[int] = field(default_factory=lambda: [0])
    chars: list[int] = field(default_factory=lambda: [0])
    link_chars: list[int] = field(default_factory=lambda: [0])
    blocks: list[tuple[int, str]] = field(default_factory=list)
    marks: list[str] = field(default_factory=lambda: [""])


def names_of(attributes: str) -> tuple[tuple[str, ...], str]:
    """Words of the naming attributes, and the data label of training pages."""
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return (), ""
    out, mark = [], ""
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        value = a or b or c
        key = key.lower()
        if key in ("hidden", "aria-hidden"):
            out += ["hidden"] if value.lower() != "false" else []
        elif key == "style":
            out += ["hidden"] if "display:none" in value.lower().replace(" ", "") else []
        else:
            out += [n.lower() for n in NAME.findall(value)]
    if "data-mark" in attributes:
        mark = attributes.partition("data-mark=")[2][1:].partition('"')[0]
    return tuple(out), mark


class Scanner:
    """Where tags and skipped elements of a page end, each found in time linear in what is passed over."""

    def __init__(self, page: str):
        self.page = page
        self.last = {q: page.rfind(q) for q in "\"'"}
        self.absent: set[str] = set()  # controls of which no start or end tag follows any more
        self.ends: dict[str, re.Pattern] = {}

    def tag(self, at: int) -> int:
        """The > that ends a tag whose name ends at `at`, quoted attribute values passed over; -1 if there is none."""
        stop = self.page.find(">", at)
        while stop >= 0 and (m := QUOTED.search(self.page, at, stop)):
            if self.last[m[1]] < m.end():  # a quote that never closes quotes nothing
                at = m.end()
                continue
            at = self.page.find(m[1], m.end()) + 1
            if at > stop:
                stop = self.page.find(">", at)
        return stop

    def raw(self, tag: str, at: int) -> int:
        """Past the end tag of an element without markup; the end of the page if there is none."""
        if tag not in self.ends:
            self.ends[tag] = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I)
        m = self.ends[tag].search(self.page, at)
        return self.past(m.end()) if m else len(self.page)

    def control(self, tag: str, at: int) -> int:
        """Past a control that begins before `at`; one that is never closed holds only the text up to the next tag."""
        m = None if tag in self.absent else CONTROLS[tag].search(self.page, at)
        if m and m[1]:
            return self.past(m.end())
        if m and tag == "option":
            return m.start()
        if not m:
            self.absent.add(tag)
        if tag == "select":
            return at
        stop = self.page.find("<", at)
        return len(self.page) if stop < 0 else stop

    def past(self, at: int) -> int:
        stop = self.page.find(">", at)
        return len(self.page) if stop < 0 else stop + 1


class Open:
    """Open tags with their block elements, and where each name is open, so that no search walks the stack."""

    def __init__(self):
        self.tags: list[tuple[str, int]] = [("#page", 0)]
        self.at: dict[str, list[int]] = {}
        self.solid = [0]  # places of tags that part blocks
        self.links = 0

    def push(self, tag: str, block: int) -> None:
        self.at.setdefault(tag, []).append(len(self.tags))
        if tag not in INLINE:
            self.solid.append(len(self.tags))
        self.links += tag == "a"
        self.tags.append((tag, block))

    def place(self, *names: str) -> int:
        """Where the innermost of these is open; -1 if none is."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def pop_to(self, place: int) -> None:
        while len(self.tags) > place:
            self.drop()

    def drop(self) -> None:
        tag, _ = self.tags.pop()
        if tag:
            self.at[tag].pop()
            self.links -= tag == "a"
            if tag not in INLINE:
                self.solid.pop()

    def close_inline(self, tag: str) -> None:
        """Close the innermost such tag inside the innermost block; tags opened after it stay open."""
        place = self.place(tag)
        if place <= self.solid[-1]:
            return
        self.tags[place] = ("", self.tags[place][1])
        self.at[tag].pop()
        self.links -= tag == "a"
        while not self.tags[-1][0]:
            self.tags.pop()


def parse(page: str) -> Tree:
    """Forgiving parser: unclosed and stray tags end where a browser would end them, near enough; linear in the page."""
    tree, scan, open_tags = Tree(), Scanner(page), Open()
    text: list[str] = []
    size, at, tags_follow = len(page), 0, True

    def add(data: str) -> None:
        text.append(data)
        block = open_tags.tags[-1][1]
        tree.chars[block] += len(data)
        if open_tags.links:
            tree.link_chars[block] += len(data)

    def close_block() -> None:
        if text:
            own = " ".join(html.unescape("".join(text)).split())
            if own:
                tree.blocks.append((open_tags.tags[-1][1], own))
            text.clear()

    def pop_to(place: int) -> None:
        close_block()
        open_tags.pop_to(place)

    while at < size:
        begin = page.find("<", at)
        if begin != at:
            begin = size if begin < 0 else begin
            add(page[at:begin])
            at = begin
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = size if end < 0 else end + 3
            continue
        if page[at + 1 : at + 2] in ("!", "?"):
            at = scan.past(at)
            continue
        m = START.match(page, at) if tags_follow else None
        end = scan.tag(m.end()) if m else -1
        if end < 0:
            tags_follow = tags_follow and not m
            add("<")
            at += 1
            continue
        tag, attributes, at = m[2].lower(), page[m.end() : end], end + 1
        if m[1]:
            if tag in INLINE:
                open_tags.close_inline(tag)
            elif tag != "br" and (place := open_tags.place(tag)) > 0:
                pop_to(place)
            else:
                close_block()
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                at = scan.raw(tag, at)
            continue
        if tag in CONTROLS:
            at = scan.control(tag, at)
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                close_block()
            continue
        if tag in INLINE:
            if not attributes.endswith("/") or tag == "a":
                open_tags.push(tag, open_tags.tags[-1][1])
            continue
        close_block()
        if tag in ENDS_P:
            if open_tags.tags[open_tags.solid[-1]][0] == "p":
                pop_to(open_tags.solid[-1])
        elif tag in SELF_NESTED:
            ended, bounds = SELF_NESTED[tag]
            if (place := open_tags.place(*ended)) > max(0, open_tags.place(*bounds)):
                pop_to(place)
        parent = open_tags.tags[-1][1]
        names, mark = names_of(attributes)
        tree.tags.append(tag)
        tree.names.append(names)
        tree.parents.append(parent)
        tree.depths.append(tree.depths[parent] + 1)
        tree.chars.append(0)
        tree.link_chars.append(0)
        tree.marks.append(mark)
        if not attributes.endswith("/"):
            open_tags.push(tag, len(tree.tags) - 1)
    close_block()
    return tree


#: Elements that parts of a page are made of, and words that name them, for the pages made to train on.
PARTS = {
    "nav": ("nav", "nav navbar navigation menu breadcrumb breadcrumbs topnav pagination pager toc crumbs links"),
    "header": ("header", "header masthead banner branding logo topbar"),
    "footer": ("footer", "footer copyright bottom colophon legal imprint info credits"),
    "aside": ("aside", "sidebar side widget related recommended stories rail trending popular more teaser"),
    "notice": ("div", "cookie cookies consent gdpr notice alert popup modal overlay announcement paywall warning message privacy"),
    "ad": ("div", "ad ads advert advertisement advertising sponsored sponsor promo promotion adsbox adslot commercial"),
    "form": ("form", "form search newsletter subscribe subscription login signup signin contact register"),
    "comments": ("section", "comments comment discussion replies reply respond reviews disqus feedback responses"),
    "share": ("div", "share sharing social tools toolbar bio tags follow buttons rating"),
}
#: Words put around such names, and names that say nothing of what they hold.
AROUND = "site page main user reader the block box area wrap section list bar widget container inner module item top new".split()
CONTENT = "article content post entry main story body text post-content entry-content article-body articleBody storyText prose".split()
NEUTRAL = "container wrapper row col inner grid layout page outer wrap center box panel block app root".split()
#: What such parts often say, in the languages of the pages.
SAID = {
    "nav": "Home|About us|Contact|Menu|Next|Previous|Startseite|Accueil|Inicio|Kontakt|Skip to content|News|Sport",
    "header": "Menu|Welcome|Your daily source|Log in|Subscribe",
    "footer": "Copyright|All rights reserved|Privacy policy|Terms of use|Impressum|Datenschutz|Mentions légales|Powered by|Contact us",
    "aside": "Related articles|Most read|Popular posts|You may also like|Read more|Mehr zum Thema|À lire aussi|Trending now|Latest news",
    "notice": "We use cookies|Accept all|By continuing you agree to our privacy policy|Your consent|Wir verwenden Cookies|Nous utilisons des cookies|Subscribe to continue reading",
    "ad": "Advertisement|Sponsored|Buy now|Special offer|Werbung|Anzeige|Publicité|Publicidad|Save today|Free shipping|Order yours",
    "form": "Search|Sign up for our newsletter|Enter your email|Log in|Subscribe|Anmelden|Submit",
    "comments": "Reply|Comments|Leave a comment|says:|posted|Kommentare|Antworten|Commentaires|Responder|Report",
    "share": "Share this|Tweet|Facebook|Follow us|Print|Email|Teilen|Partager|Tags",
}
BOILERPLATE = frozenset(w for said in SAID.values() for w in re.findall(r"[^\W\d_]{4,}", said.lower())) - {"today", "with", "your", "this", "more", "zum"}
SYLLABLES = "ba de ki lo mu ne ra si to vu".split()


def _words(rng: random.Random, least: int, most: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(rng.randint(least, most)))


def _name(rng: random.Random, word: str) -> str:
    """A name as pages write it: alone, with a word before or behind it, in one of several spellings."""
    parts = [word]
    if rng.random() < 0.6:
        parts.insert(rng.randint(0, 1), rng.choice(AROUND))
    if rng.random() < 0.2:
        return parts[0] + "".join(p.capitalize() for p in parts[1:])
    return rng.choice("--_ ").join(parts)


def labelled_page(rng: random.Random) -> str:
    """A page whose block elements carry their label: data-mark="1" for content, "0" for all else."""
    common = sorted(BOILERPLATE)

    def own(tag: str, mark: int, inner: str, names: str = "") -> str:
        attribute = f' {rng.choice(["class", "class", "id"])}="{names}"' if names else ""
        return f'<{tag}{attribute} data-mark="{mark}">{inner}</{tag}>'

    def wrapped(inner: str, mark: int, most: int) -> str:
        """The same inside some elements that say nothing of it."""
        for _ in range(rng.randint(0, most)):
            inner = own(rng.choice(["div", "div", "div", "section"]), mark, inner, rng.choice(NEUTRAL) if rng.random() < 0.3 else "")
        return inner

    def link(text: str) -> str:
        return f'<a href="/x">{text}</a>'

    def running(least: int, most: int) -> str:
        """Prose, in which any word may occur."""
        words = _words(rng, least, most).split()
        for _ in range(len(words) // 8):
            words[rng.randrange(len(words))] = rng.choice(common)
        return " ".join(words)

    def listed(mark: int, links: bool, n: int) -> str:
        items = [own("li", mark, link(_words(rng, 1, 4)) if links else _words(rng, 2, 20)) for _ in range(n)]
        return own(rng.choice(["ul", "ul", "ol"]), mark, "".join(items))

    def said(kind: str) -> str:
        text = rng.choice(SAID[kind].split("|"))
        return text + (" " + _words(rng, 1, 6) + "." if rng.random() < 0.5 else "")

    def comment() -> str:
        head = own(rng.choice(["div", "span", "p", "h4"]), 0, _words(rng, 1, 2) + rng.choice(["", " " + said("comments"), " 3 May 2021"]))
        tail = own("div", 0, link("Reply")) if rng.random() < 0.5 else ""
        return own(rng.choice(["div", "article", "li"]), 0, head + wrapped(own("p", 0, _words(rng, 3, 80)), 0, 1) + tail, _name(rng, "comment") if rng.random() < 0.5 else "")

    def junk(kind: str) -> str:
        tag, words = PARTS[kind]
        named = rng.random() < 0.85
        if named and rng.random() < 0.5 or tag == "div":
            tag = rng.choice(["div", "div", "div", "section", "aside", "ul"]) if tag != "form" else tag
        name = _name(rng, rng.choice(words.split())) if named else ""
        telling = named or tag in ("nav", "footer", "aside", "form")
        if kind == "nav":
            inner = listed(0, True, rng.randint(2, 8)) if rng.random() < 0.7 else "".join(link(_words(rng, 1, 3)) + " " for _ in range(rng.randint(3, 9)))
        elif kind == "comments":
            head = own(rng.choice(["h3", "h2", "p"]), 0, said("comments") if rng.random() < 0.7 or not named else _words(rng, 1, 3)) if rng.random() < 0.8 or not named else ""
            inner = head + "".join(comment() for _ in range(rng.randint(1, 6)))
        elif kind == "header":
            inner = own(rng.choice(["h1", "div", "p"]), 0, link(_words(rng, 1, 3))) + (own("p", 0, said("header")) if rng.random() < 0.4 else "")
        else:
            plain = [lambda: own("p", 0, said(kind)), lambda: said(kind), lambda: listed(0, True, rng.randint(2, 8))]
            free = [lambda: _words(rng, 1, 15), lambda: own("p", 0, _words(rng, 3, 60)), lambda: own("div", 0, own("p", 0, _words(rng, 2, 50)))]
            say = rng.choice([plain, free, free, plain + free] if telling else [plain])  # a name alone tells enough
            inner = "".join(rng.choice(say)() for _ in range(rng.randint(1, 3)))
        out = own(tag, 0, wrapped(inner, 0, 2), name)
        return wrapped(out, 0, 2) if rng.random() < 0.3 else out

    def prose() -> str:
        parts = []
        for _ in range(rng.randint(1, rng.choice([1, 2, 4, 9]))):
            kind = rng.random()
            if kind < 0.65:
                parts.append(own("p", 1, running(1, 120) if rng.random() < 0.8 else _words(rng, 4, 20) + " " + link(_words(rng, 1, 3)) + " " + running(4, 30)))
            elif kind < 0.72:
                parts.append(own(rng.choice(["h2", "h3"]), 1, _words(rng, 1, 8)))
            elif kind < 0.8:
                parts.append(listed(1, rng.random() < 0.15, rng.randint(2, 6)))
            elif kind < 0.85:
                parts.append(own("blockquote", 1, own("p", 1, running(4, 40))))
            elif kind < 0.88:
                parts.append(own("table", 1, "".join(own("tr", 1, "".join(own("td", 1, _words(rng, 1, 3)) for _ in range(3))) for _ in range(rng.randint(1, 4)))))
            elif kind < 0.94:
                parts.append(wrapped(own("div", 1, own("p", 1, running(5, 60)) if rng.random() < 0.6 else running(5, 80)), 1, 2))
            else:
                parts.append(junk(rng.choice(["ad", "share", "aside", "notice", "form"])))
        if rng.random() < 0.2:  # text that stands in the element itself, parted by breaks
            parts = [running(10, 80) + "<br>" + running(10, 80)]
        return "".join(parts)

    title = own("h1", 1, _words(rng, 1, 12)) if rng.random() < 0.85 else ""
    outside = ""
    if title and rng.random() < 0.3:
        title = own("header", 1, title, _name(rng, rng.choice(["entry", "post", "article"])) if rng.random() < 0.4 else "")
        if rng.random() < 0.4:
            title, outside = "", title
    tag = rng.choice(["article", "article", "main", "div", "div", "div", "section"])
    name = _name(rng, rng.choice(CONTENT)) if rng.random() < 0.5 else ""
    body = own(tag, 1, wrapped(title + wrapped(prose(), 1, 3), 1, 2), name)
    body = wrapped(body, 1, rng.choice([0, 1, 2, 8]))
    if rng.random() < 0.3:
        body = own(rng.choice(["main", "div"]), 1, body, _name(rng, rng.choice(["main", "content"])) if rng.random() < 0.6 else "")
    after = [junk(k) for k in rng.sample(["aside", "comments", "share", "ad", "form"], rng.randint(0, 2))]
    if rng.random() < 0.4:
        before = [junk(k) for k in rng.sample(["aside", "ad", "notice", "nav"], rng.randint(0, 2))]
        body = wrapped(own("div", 1, "".join(before) + outside + body + "".join(after), rng.choice(NEUTRAL) if rng.random() < 0.5 else ""), 1, 2)
        outside, after = "", []
    above = [junk(k) for k in rng.sample(["nav", "header", "notice", "ad", "form", "share"], rng.randint(0, 4))]
    below = after + [junk(k) for k in rng.sample(["footer", "aside", "comments", "ad", "form", "nav", "share", "notice"], rng.randint(0, 5))]
    inner = "".join(above) + outside + body + "".join(below)
    if rng.random() < 0.3:
        inner = own("div", 1, inner, rng.choice(NEUTRAL) if rng.random() < 0.5 else "")
    return f'<html data-mark="1"><body data-mark="1">{inner}</body></html>'
