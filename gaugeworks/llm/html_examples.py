"""Labelled pages that the decision tree of ``html_text`` is grown on, and held-out ones.

Pages are put together from parts by a seeded rule: a frame of menus, headers, notices,
adverts, forms, comments and footers around an article, each in one of several
mark-ups.  Most pages have no ``<article>`` or ``<main>``; many have no telling class
name either, so that only word counts and link densities part the two.  Elements with
``data-main`` hold main text; the attribute serves as label only and is no feature.
"""

from __future__ import annotations

from random import Random

#: Words of the invented prose (fixed values).
STEMS = "river town winter market teacher engine garden window council letter bridge summer harbour forest village doctor paper morning island valley".split()
VERBS = "crossed mended opened carried followed watched painted counted answered visited".split()
SMALL = "the a of and in to under near with after before over".split()

#: Mark-ups of the article: opening and closing tags, or none for bare paragraphs in the body.
MAIN_MARKUPS = (
    ("<article>", "</article>"),
    ("<main>", "</main>"),
    ("<div role=main>", "</div>"),
    ("<div class=post-content>", "</div>"),
    ("<div id=c1>", "</div>"),
    ("<div>", "</div>"),
    ("<div><div class=col>", "</div></div>"),
    ("<section>", "</section>"),
    ("<table><tr><td>", "</td></tr></table>"),
    ("", ""),
)
#: How the article's text is cut up inside.
BODIES = ("paragraphs", "unclosed", "divs", "breaks", "sections", "lists")
#: Frames that only a name, a tag or a role tells from prose.
NAMED_PROSE = (
    ("<aside>", "</aside>"),
    ("<footer>", "</footer>"),
    ("<header>", "</header>"),
    ("<form>", "</form>"),
    ("<div class=sidebar>", "</div>"),
    ("<div class='comments-section'>", "</div>"),
    ("<section id=comments>", "</section>"),
    ("<ul class=comment-list><li>", "</li></ul>"),
    ("<div class='cookie-notice banner'>", "</div>"),
    ("<div class=ad>", "</div>"),
    ("<div class=advert-box>", "</div>"),
    ("<div role=dialog>", "</div>"),
    ("<div id=newsletter>", "</div>"),
    ("<div class=related-posts>", "</div>"),
)


def sentence(rng: Random, words: int) -> str:
    """Invented prose of about so many words."""
    out = []
    while len(out) < words:
        out += [rng.choice(SMALL), rng.choice(STEMS), rng.choice(VERBS), rng.choice(SMALL), rng.choice(STEMS)]
    text = " ".join(out[:words])
    return text[0].upper() + text[1:] + "."


def prose(rng: Random) -> str:
    """A paragraph: mostly long, at times a few words."""
    if rng.random() < 0.25:
        return sentence(rng, rng.randint(1, 7))
    return " ".join(sentence(rng, rng.randint(6, 24)) for _ in range(rng.randint(1, 5)))


def link(rng: Random, words: int) -> str:
    return f"<a href=/{rng.randrange(999)}>{sentence(rng, words)[:-1]}</a>"


def menu(rng: Random) -> str:
    """Links and little else, in one of several mark-ups."""
    items = [link(rng, rng.randint(1, 3)) for _ in range(rng.randint(2, 8))]
    kind = rng.randrange(5)
    if kind == 0:
        return "<nav><ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul></nav>"
    if kind == 1:
        return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
    if kind == 2:
        return "<div>" + rng.choice((" | ", " ", " &middot; ")).join(items) + "</div>"
    if kind == 3:
        return "<table><tr>" + "".join(f"<td>{i}</td>" for i in items) + "</tr></table>"
    return "<div class=menu>" + "".join(f"<div>{i}</div>" for i in items) + "</div>"


def teasers(rng: Random) -> str:
    """A heading over links to other articles, or links around a heading and a line each."""
    if rng.random() < 0.4:
        return "<div>" + "".join(f"<a href=/{rng.randrange(999)}><h3>{sentence(rng, rng.randint(2, 6))[:-1]}</h3><p>{sentence(rng, rng.randint(6, 20))}</p></a>" for _ in range(rng.randint(2, 5))) + "</div>"
    return f"<div><h3>{sentence(rng, rng.randint(1, 3))[:-1]}</h3>" + "".join(f"<p>{link(rng, rng.randint(4, 12))}</p>" for _ in range(rng.randint(2, 5))) + "</div>"


def small_print(rng: Random) -> str:
    """A short line that is no paragraph."""
    words = sentence(rng, rng.randint(1, 4))[:-1]
    return rng.choice((f"<div>{words}</div>", f"<div>&copy; {words} {link(rng, 2)}</div>", f"<div><span>{words}</span> {link(rng, 1)} {link(rng, 1)}</div>"))


def named_prose(rng: Random) -> str:
    opened, closed = rng.choice(NAMED_PROSE)
    return opened + "".join(f"<p>{prose(rng)}</p>" for _ in range(rng.randint(1, 4))) + closed


def article(rng: Random, markup: tuple[str, str], body: str) -> tuple[str, list[str]]:
    """The article's mark-up and the texts of its blocks."""
    texts: list[str] = []

    def told(text: str) -> str:
        texts.append(text)
        return text

    def linked(text: str) -> str:
        """A link around some words of a longer text."""
        words = told(text).split(" ")
        if told_apart and rng.random() < 0.06:
            return f"<a href=/x>{text}</a>"  # only where the mark-up tells that this is the article
        if len(words) > 12 and rng.random() < 0.3:
            at = rng.randrange(len(words) - 4)
            words[at], words[at + 2] = f"<a href=/x>{words[at]}", f"{words[at + 2]}</a>"
        return " ".join(words)

    def amid() -> str:
        """At times something inside the article that is none of it."""
        if rng.random() > 0.12:
            return ""
        frames = [x for x in NAMED_PROSE if x[0] != "<header>"]  # a header inside an article is of it
        opened, closed = rng.choice((*frames, ("<nav>", "</nav>"), ("<div class=share-buttons>", "</div>")))
        at = opened.index(">")
        inside = rng.choice((sentence(rng, rng.randint(2, 12)), f"<p>{prose(rng)}</p>", f"{link(rng, 2)} {link(rng, 3)}"))
        return f"{opened[:at]} data-apart>{opened[at + 1:]}{inside}{closed}"

    told_apart = any(x in markup[0] for x in ("article", "main", "content"))
    n = rng.randint(2, 9)
    inner = f"<h{rng.randint(1, 2)}>{told(sentence(rng, rng.randint(2, 9))[:-1])}</h1>".replace("</h1>", "") if rng.random() < 0.8 else ""
    inner = inner + f"</h{inner[2]}>" if inner else ""
    if not told_apart or body == "breaks":
        inner += f"<p>{linked(sentence(rng, 30))}</p>"  # nothing else tells that this is the article
    if body == "paragraphs":
        inner += "".join(f"<p>{linked(prose(rng))}</p>{amid()}" for _ in range(n))
    elif body == "unclosed":
        inner += "".join(f"<p>{linked(prose(rng))}{amid()}" for _ in range(n))
    elif body == "divs":
        inner += "".join(f"<div>{linked(prose(rng) + ' ' + sentence(rng, 15))}</div>{amid()}" for _ in range(n))
    elif body == "breaks":
        inner += f"<div>{told(prose(rng) + ' ' + sentence(rng, 30))}</div>"
    elif body == "sections":
        for _ in range(rng.randint(1, 3)):
            inner += f"<div><h3>{told(sentence(rng, rng.randint(1, 4))[:-1])}</h3>" + "".join(f"<p>{linked(prose(rng) + ' ' + sentence(rng, 12))}</p>" for _ in range(rng.randint(1, 3))) + amid() + "</div>"
    else:
        inner += f"<p>{linked(sentence(rng, 25))}</p><ul>" + "".join(f"<li>{told(sentence(rng, rng.randint(2, 14)))}</li>" for _ in range(n)) + f"</ul><p>{linked(sentence(rng, 25))}</p>"
    if not markup[0]:
        return inner.replace("<p>", "<p data-main>").replace("<div>", "<div data-main>").replace("<ul>", "<ul data-main>").replace("<h1>", "<h1 data-main>").replace("<h2>", "<h2 data-main>"), texts
    at = markup[0].rindex(">")
    return f"{markup[0][:at]} data-main>{inner}{markup[1]}", texts


def page(rng: Random, markup: tuple[str, str], body: str) -> tuple[str, list[str]]:
    """A whole page, and the texts of its main blocks."""
    main, texts = article(rng, markup, body)
    parts = (menu, named_prose, teasers, small_print)[: 4 if markup[0] else 3]  # beside bare paragraphs a short line is anyone's
    before = [f(rng) for f in rng.choices(parts, (5, 2, 1, 2)[: len(parts)], k=rng.randint(0, 4))]
    after = [f(rng) for f in rng.choices(parts, (3, 4, 3, 3)[: len(parts)], k=rng.randint(0, 4))]
    return "<body>" + "".join([*before, main, *after]) + "</body>", texts


def pages(seed: int, rounds: int, markups=MAIN_MARKUPS, bodies=BODIES) -> list[tuple[str, list[str]]]:
    """``rounds`` pages of every pair of mark-up and body."""
    rng = Random(seed)
    return [page(rng, m, b) for _ in range(rounds) for m in markups for b in bodies]
