"""Pages whose containers and adverts have misleading names, misnested tags, and mixes that come near their targets."""

import time

import pytest

from lanecraft.llm import mixing, pages

SF = "/root/testdata/sf0.001"
PARTS = [f"<p>Sentence number {k} of the article, which goes on for a while, as articles do.</p>" for k in range(8)]
ARTICLE = "<h1>A headline</h1>" + "".join(PARTS)
WANT = "A headline " + " ".join(p[3:-4] for p in PARTS)
MENU, FOOT = "<nav><ul><li><a href=/>Home</a></li><li><a href=/b>More</a></li></ul></nav>", "<footer>Imprint of the house</footer>"


@pytest.fixture(scope="module")
def model():
    return pages.trained()


@pytest.mark.parametrize(
    "page",
    [
        f"<body>{MENU}<article class='post has-comments'>{ARTICLE}</article>{FOOT}</body>",
        f"<body class='page sidebar-left'>{MENU}<article>{ARTICLE}</article>{FOOT}</body>",
        f"<body class='page sidebar-left'>{MENU}<div class='content'>{ARTICLE}</div>{FOOT}</body>",
        f"<body class='single-post right-sidebar'>{MENU}<article>{ARTICLE}</article>{FOOT}</body>",
        f"<body class='single-post right-sidebar'>{MENU}<main>{ARTICLE}</main>{FOOT}</body>",
        f"<html class='with-banner'><body>{MENU}<main class='layout has-sidebar'>{ARTICLE}</main>{FOOT}</body></html>",
    ],
)
def test_what_a_container_is_called_drops_no_article(page, model):
    assert pages.main_text(page, model) == WANT


@pytest.mark.parametrize("advert", ["<div class='ad-slot'><p>Buy this now</p></div>", "<div class='advertisement'>Buy this now</div>", "<div class='newsletter-signup'><h3>Get our letter</h3><input name=m></div>", "<form><label>Your name</label><p>Send it</p></form>"])
@pytest.mark.parametrize("after", [1, 5])
def test_adverts_and_forms_within_an_article_go(advert, after, model):
    inner = "<h1>A headline</h1>" + "".join(PARTS[:after]) + advert + "".join(PARTS[after:])
    assert pages.main_text(f"<body>{MENU}<article>{inner}</article>{FOOT}</body>", model) == WANT


@pytest.mark.parametrize("piece", ["<b>x</i>", "<b>x<p>y", "<i><h1>x", "<td><b><h1>", "<li><b>x"])
def test_misnested_tags_take_time_as_they_are_long(piece):
    began = time.time()
    nodes = pages.parsed(piece * (1_000_000 // len(piece)))
    assert time.time() - began < 15 and len(nodes) > 1


def test_mixes_come_near_every_target(spark):
    """Within 1 % where sources are large; in small ones no document more, or less, would bring one nearer."""
    for sf, large in (("sf0.001", False), ("sf0.1", True)):
        sources = {}
        for r in mixing.copies(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).collect():
            sources.setdefault((r["target"], r["source_size"]), []).append((r["size"], r["copies"]))
        for (target, _), rows in sources.items():
            off = target - sum(size * copies for size, copies in rows)
            if large or abs(off) > 0.01 * target:
                able = [size for size, copies in rows if (copies < mixing.MOST if off > 0 else copies > 0)]
                assert abs(off) <= 0.01 * target or not large and all(abs(size - abs(off)) >= abs(off) for size in able)
