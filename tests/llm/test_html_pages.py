"""Main text of pages written by hand, after common layouts; none comes from the generator that the model is trained on.

Article words are marked by the letter K in front, words to be removed by an X, so that recall of both can be counted.
"""

import re

import pytest

from factloom.llm.html_extract import extract, standard_model


def k(text):
    return " ".join("K" + w for w in text.split())


def x(text):
    return " ".join("X" + w for w in text.split())


A = k("The council met on Monday evening to talk about the new bridge over the river and what it would cost the town to build it.")
B = k("Most members were in favour, but some asked for a second survey of the ground before any money is spent on the work.")
C = k("The survey is to be ready by autumn, and a vote will follow once the figures are known to everyone in the town.")
D = k("It was a short winter.")
MENU = "<ul><li><a href=/>" + x("Home") + "</a></li><li><a href=/n>" + x("News") + "</a></li><li><a href=/s>" + x("Sport and leisure") + "</a></li></ul>"
LINKS = "".join(f"<a href=/{i}>{x('Section number')} </a>" for i in range(5))
JUNK = x("Nobody asked for any of these words to stand on this page.")
COMMENT = x("I have walked across that river every day for years and never once wished for a bridge, to be honest.")

PAGES = [
    f"<body><div><div><p>{A}</p></div></div>",
    f"<body><div><div><div><p>{A}</p></div></div></div>",
    f"<body><div><div><div><div><div><p>{A}</p><p>{B}</p><p>{C}</p></div></div></div></div></div>",
    f"<body><div><div><div><div><div><div><div><div><p>{A}</p><p>{B}</p></div></div></div></div></div></div></div></div>",
    f"<body><header><a href=/>{x('Daily Paper')}</a></header><div><div><h1>{k('Bridge plans')}</h1><p>{A}</p><p>{B}</p></div></div><footer>{x('Imprint and terms')}</footer>",
    *[
        f"<body><div class=post><h1>{k('Bridge plans')}</h1><p>{A}</p><p>{B}</p></div><div class='{c}'><p>{JUNK}</p></div>"
        for c in ("comments-area", "user-comments", "newsletter-box", "cookies", "site-info", "advertising", "breadcrumbs", "cookie-bar", "site-footer", "comment-respond", "userComments", "sidebar-left")
    ],
    f"<body><div id=discussion-wrap><h3>{x('Discussion')}</h3><div><p>{COMMENT}</p></div><div><p>{COMMENT}</p></div></div>".replace("<body>", f"<body><article><p>{A}</p><p>{B}</p><p>{C}</p></article>"),
    f"<body><nav>{MENU}</nav><main><h1>{k('Bridge plans')}</h1><p>{A}</p><ul><li>{D}</li><li>{D}</li></ul><p>{B}</p></main><aside><h4>{x('Most read')}</h4>{MENU}</aside><footer><p>{x('Copyright Daily Paper')}</p></footer>",
    f"<body><div id=wrapper><div id=header>{LINKS}</div><div id=content><div class=entry><h2>{k('Bridge plans')}</h2><p>{A}</p><p>{B}</p><p>{C}</p></div></div><div id=sidebar><h3>{x('Archives')}</h3>{MENU}</div><div id=footer>{x('Powered by a blog')}</div></div>",
    f"<body><table><tr><td class=nav>{LINKS}</td><td><p>{A}</p><p>{B}</p><p>{C}</p></td></tr></table>",
    f"<body><div class=cookie-consent><p>{x('We use cookies to make this site work')}</p><button>OK</button></div><div class=page><section><h1>{k('Bridge plans')}</h1><div><p>{A}</p></div><div><p>{B}</p></div></section></div>",
    f"<body><div><div>{LINKS}</div></div><div><div><h1>{k('Bridge plans')}</h1><p>{A}</p><p>{B}</p><p>{C}</p></div></div><div><div>{LINKS}</div></div>",
    f"<body><article><header><h1>{k('Bridge plans')}</h1></header><p>{A}</p><div class=ad-slot>{x('Advertisement Buy now')}</div><p>{B}</p><div class=share-buttons><a>{x('Tweet')}</a> <a>{x('Share')}</a></div></article>",
    f"<body><article><p>{A}</p><blockquote><p>{B}</p></blockquote><p>{C}</p></article><section class=reader-comments><h3>{x('Comments')}</h3><div><b>{x('Ann')}</b><p>{COMMENT}</p><a>{x('Reply')}</a></div><div><b>{x('Bob')}</b><p>{COMMENT}</p><a>{x('Reply')}</a></div></section>",
    f"<body><div class=mw-body><h1>{k('Bridge')}</h1><div class=toc>{MENU}</div><p>{A}</p><h2>{k('History of it')}</h2><p>{B}</p><p>{C}</p></div><div id=mw-panel>{MENU}</div>",
    f"<body><main id=main role=main><div class=container><div class=row><div class=col-md-8><h1>{k('Bridge plans')}</h1><p>{A}</p><p>{B}</p></div><div class='col-md-4 widget-area'><h3>{x('Related articles')}</h3>{MENU}</div></div></div></main>",
    f"<body>{A}<br><br>{B}<br><br>{C}",
    f"<body><div>{A}<br>{B}</div><form><p>{x('Enter your email')}</p></form>",
    f"<body><div class=story><p>{A}<p>{B}<p>{C}</div><div class=newsletter><h3>{x('Sign up for our newsletter')}</h3><p>{x('Enter your email below')}</p></div>",
    f"<body><div role=navigation>{LINKS}</div><div role=main><p>{A}</p><p>{B}</p></div><div role=contentinfo>{x('All rights reserved')}</div>",
    f"<body><section class=hero><h1>{k('Bridge plans')}</h1></section><section><p>{A}</p><p>{B}</p></section><section><p>{C}</p></section><footer>{MENU}<p>{x('Privacy policy')}</p></footer>",
    f"<body><div class=post-content><p>{A}</p><p>{B}</p></div><div class=author-bio><p>{x('The writer lives in town.')}</p></div><div class=related-posts><h4>{x('You may also like')}</h4>{MENU}</div><div id=disqus_thread><p>{COMMENT}</p></div>",
    f"<body><div class=gdpr-banner>{x('Accept all or manage settings')}</div><nav class=topnav>{LINKS}</nav><div class=layout><article class=news-article><h1>{k('Bridge plans')}</h1><p>{A}</p><p>{B}</p><table><tr><td>{k('Cost')}</td><td>{k('nine')}</td></tr></table></article></div>",
    f"<body><div class=paywall-overlay><p>{x('Subscribe to continue reading')}</p></div><div class=articleBody><p>{A}</p><p>{B}</p><p>{C}</p></div>",
    f"<body><div class=promo-box>{x('Special offer for members only')}</div><div class=text><p>{A}</p><h3>{k('And then')}</h3><p>{B}</p></div><div class=pagination><a>{x('Previous')}</a><a>{x('Next')}</a></div>",
    f"<body><div id=page><div id=masthead><h1><a href=/>{x('My site')}</a></h1><p>{x('Welcome to this place')}</p></div><div id=primary><div class=hentry><h1>{k('Bridge plans')}</h1><p>{A}</p><p>{B}</p></div></div><div id=colophon>{x('Proudly powered')}</div></div>",
    f"<body><article><h1>{k('Bridge plans')}</h1><p>{A} <a href=/more>{k('by the town itself')}</a> {B}</p><figure><figcaption>{D}</figcaption></figure><p>{C}</p></article><div class=most-popular>{MENU}</div>",
]


def recall(page, text):
    """Article words kept and words to be removed that are gone, with how many there are of each."""
    words, left = re.findall(r"[KX][\w,.]+", re.sub(r"<[^>]*>", " ", page)), text.split()
    own, junk = [w for w in words if w[0] == "K"], [w for w in words if w[0] == "X"]
    return sum(w[0] == "K" for w in left), len(own), len(junk) - sum(w[0] == "X" for w in left), len(junk)


def test_hand_written_pages():
    assert len(PAGES) >= 30
    got = [recall(p, t) for p, t in zip(PAGES, extract(PAGES, standard_model()), strict=True)]
    kept, own, gone, junk = map(sum, zip(*got, strict=True))
    assert kept >= 0.9 * own and gone >= 0.9 * junk, (kept / own, gone / junk, [i for i, g in enumerate(got) if g[0] < g[1] or g[2] < g[3]])
    assert sum(g[0] >= 0.9 * g[1] for g in got) >= 0.9 * len(PAGES)


@pytest.mark.parametrize("wrappers", range(9))
def test_unnamed_wrappers_keep_the_article(wrappers):
    page = f"<body><nav>{MENU}</nav>" + "<div>" * wrappers + f"<p>{A}</p><p>{B}</p>" + "</div>" * wrappers + f"<footer>{x('Imprint')}</footer>"
    assert extract([page], standard_model()) == [f"{A} {B}"]
