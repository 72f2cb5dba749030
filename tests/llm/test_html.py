"""Main text of pages written by hand, in layouts that no maker wrote."""

import random

import pytest

from casewright.llm import html

A = "The river rose by two metres in the night, and the lower town had to be cleared before dawn."
B = "Boats went from door to door, said the mayor, and nobody was hurt."
C = "By noon the water had begun to fall again."
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul></nav>'
FOOT = "<footer><p>© 2024 The Daily. All rights reserved.</p></footer>"
SIDE = '<aside><h3>Weather</h3><p>Rain until Sunday.</p></aside>'
#: Pages and their articles.
PAGES = [
    ("<p>Hello there.</p>", "Hello there."), ("<div>Short text without a mark</div>", "Short text without a mark"), ("Just words", "Just words"), (f"<html><body><h1>Flood</h1><p>{A}</p></body></html>", f"Flood {A}"),
    (f"<body>{NAV}<article><h1>Flood</h1><p>{A}</p><p>{B}</p></article>{FOOT}</body>", f"Flood {A} {B}"), (f"<body>{NAV}<main><h1>Flood</h1><p>{A}</p><p>{B}</p><p>{C}</p></main>{SIDE}{FOOT}</body>", f"Flood {A} {B} {C}"),
    (f"<body>{NAV}<main><h1>API</h1><dl><dt>open</dt><dd>Opens the file and returns a handle to it.</dd><dt>close</dt><dd>Closes the handle; later calls do nothing.</dd></dl></main>{FOOT}</body>", "API open Opens the file and returns a handle to it. close Closes the handle; later calls do nothing."),
    (f"<body><article><h1>Flood</h1><p>{A}</p><p>{B}</p></article><div id='footer'><ul><li>This page was last edited on 3 May 2024.</li><li>Terms of use</li></ul></div></body>", f"Flood {A} {B}"),
    (f"<body><div class='content'><h1>Flood</h1><p>{A}</p><p>{B}</p><h2>Related stories</h2><ul><li><a href='/1'>Dam to be raised</a></li><li><a href='/2'>Bridge closed</a></li></ul></div></body>", f"Flood {A} {B}"),
    (f"<table><tr><td>Home | About | Contact</td></tr><tr><td><h1>Flood</h1><p>{A}</p><p>{B}</p></td></tr></table>", f"Flood {A} {B}"), (f"<table><tr><td><a href='/'>Home</a> | <a href='/a'>About</a></td></tr><tr><td><h1>Flood</h1><p>{A}</p><p>{C}</p></td></tr></table>", f"Flood {A} {C}"),
    (f"<body>{NAV}<div id='main'><h2>Flood</h2>{A}<br><br>{B}</div>{FOOT}</body>", f"Flood {A} {B}"), (f"<body><header><p>The Daily</p>{NAV}</header><section><h1>Flood</h1><p>{A}</p><p>{B}</p></section>{FOOT}</body>", f"Flood {A} {B}"),
    (f"<body>{NAV}<article><h1>Flood</h1><p>{A}</p><ul><li>Lower town cleared</li><li>Two roads closed</li></ul><p>{C}</p></article>{FOOT}</body>", f"Flood {A} Lower town cleared Two roads closed {C}"), (f"<body>{NAV}<article><h1>Flood</h1><p>{A}</p><blockquote><p>{B}</p></blockquote></article>{FOOT}</body>", f"Flood {A} {B}"),
    (f"<body>{NAV}<article><h1>Flood</h1><p>{A}</p></article><section id='comments'><h2>Comments</h2><div class='comment'><b>Ann</b><p>We were there, it was bad.</p></div></section>{FOOT}</body>", f"Flood {A}"), (f"<body><div class='cookie-banner'><p>We use cookies. Accept?</p></div>{NAV}<article><h1>Flood</h1><p>{A}</p><p>{B}</p></article></body>", f"Flood {A} {B}"),
    (f"<body>{NAV}<article><h1>Flood</h1><p>{A}</p><div class='ad'><p>Buy boots today!</p></div><p>{B}</p></article>{FOOT}</body>", f"Flood {A} {B}"), (f"<body>{NAV}<article><h1>Flood</h1><p>{A}</p><form class='newsletter'><label>Your mail</label><button>Subscribe</button></form><p>{B}</p></article>{FOOT}</body>", f"Flood {A} {B}"),
    (f"<body><div class='sidebar'><h4>Popular</h4><ul><li><a href='/1'>Fair opens</a></li></ul></div><div class='post'><h1>Flood</h1><p>{A}</p><p>{C}</p></div>{FOOT}</body>", f"Flood {A} {C}"), (f"<body>{NAV}<div class='x1'><div class='x2'><h1>Flood</h1><p>{A}</p><p>{B}</p></div></div><div class='x3'><p><a href='/p'>Imprint</a></p></div></body>", f"Flood {A} {B}"),
    (f"<body>{NAV}<main><h1>Flood</h1><h2>What happened</h2><p>{A}</p><h2>What comes next</h2><p>{C}</p></main>{FOOT}</body>", f"Flood What happened {A} What comes next {C}"), (f"<body>{NAV}<article><h1>Flood</h1><p>{A}<p>{B}<p>{C}</article>{FOOT}", f"Flood {A} {B} {C}"),
    (f"<body><p><a href='/'>Home</a> &gt; <a href='/n'>News</a></p><article><h1>Flood &amp; after</h1><p>{A}</p><p>{B}</p></article>{FOOT}</body>", f"Flood & after {A} {B}"), (f"<body>{NAV}<article><h1>Code</h1><p>{A}</p><pre>x = 1\ny = 2</pre><p>{C}</p></article>{FOOT}</body>", f"Code {A} x = 1 y = 2 {C}"),
    (f"<body>{NAV}<article><h1>Table</h1><p>{A}</p><table><tr><td>Rain</td><td>90 mm</td></tr></table><p>{C}</p></article>{FOOT}</body>", f"Table {A} Rain 90 mm {C}"), (f"<body>{NAV}<article><header><h1>Flood</h1></header><p>{A}</p><p>{B}</p></article><div class='share'><a href='/t'>Tweet</a><a href='/m'>Mail</a></div>{FOOT}</body>", f"Flood {A} {B}"),
    (f"<body>{NAV}<div role='main'><h1>Flood</h1><p>{A}</p><p>{B}</p></div><div role='navigation'><ul><li><a href='/2'>Next</a></li></ul></div></body>", f"Flood {A} {B}"), (f"<body>{NAV}<article data-slug='hidden-water'><h1>Flood</h1><p>{A}</p><p hidden>Not to be seen.</p></article>{FOOT}</body>", f"Flood {A}"),
    (f"<body><center><a href='/'>Home</a> · <a href='/b'>Blog</a> · <a href='/c'>Contact</a></center><h1>Flood</h1><p>{A}</p><p>{B}</p><p>{C}</p><hr><p>© 2024 Someone</p></body>", f"Flood {A} {B} {C}"), (f"<body>{NAV}<article><h1>Flood</h1><figure><img src='a'><figcaption>The bridge at dawn</figcaption></figure><p>{A}</p><p>{B}</p></article>{FOOT}</body>", f"Flood The bridge at dawn {A} {B}"),
    (f"<body>{NAV}<main><article><h1>Flood</h1><p>{A}</p><p>{B}</p></article><div><h3>You may also like</h3><ul><li><a href='/1'>Dam raised</a></li></ul></div></main>{FOOT}</body>", f"Flood {A} {B}"),
]
#: The pages that the last report named, which all have to be right.
NAMED = (0, 1, 6, 7, 8, 9)


def test_pages_by_hand_are_extracted_whole():
    assert len(PAGES) >= 30
    wrong = [(k, html.main_text(page), want) for k, (page, want) in enumerate(PAGES) if html.main_text(page) != want]
    assert len(wrong) <= 2 and not [w for w in wrong if w[0] in NAMED], wrong


@pytest.mark.parametrize("seed", [11, 12])
def test_blocks_of_unseen_made_pages(seed):
    rng = random.Random(seed)
    model, right, blocks, whole = html.trained(), 0, 0, 0
    for _ in range(200):
        page, labels = html.labelled_page(rng)
        texts, features = html.blocks(page, model)
        assert len(texts) == len(labels)
        got = html.viterbi([sum(model.weight_list[i] for i in f) for f in features], model)
        right, blocks, whole = right + sum(a == b for a, b in zip(got, labels, strict=True)), blocks + len(labels), whole + (got == labels)
    assert right > 0.99 * blocks and whole > 0.9 * 200
