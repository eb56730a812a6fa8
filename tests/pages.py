"""Documents of our own, written from the rules of the dimensions, with known verdicts."""

# A timetable page. Every rule that a page can meet is met, most of them in another way than the usual one: labels wrap their
# inputs or are attributes, the navigation comes last, structured data is microdata as well as a script with a graph.
TIMETABLE = """<!DOCTYPE html>
<html lang="nb">
<head>
<link href="https://ferje.example/rutetabell" rel="canonical">
<script type="application/ld+json">{"@context": ["https://schema.org", {"f": "https://ferje.example/ns#"}], "@graph": [
  {"@type": "WebPage", "name": "Ferry timetable"}, {"@type": ["Organization", "LocalBusiness"], "name": "Fjord Ferries"}]}</script>
<meta content="Ferry timetable for the outer fjord" property="og:title"><meta content="https://ferje.example/boat.webp" property="og:image">
<meta content="article" property="og:type"><meta content="Departures between the islands." property="og:description">
<meta content="https://ferje.example/rutetabell" property="og:url"><meta content="summary_large_image" name="twitter:card">
<link href="https://ferje.example/en/timetable" hreflang="en" rel="alternate">
<title>Ferry timetable for the outer fjord and the islands</title>
<meta name="description" content="Departures, fares and bicycle rules of the ferries between the outer islands, with the winter and the summer timetable side by side.">
</head>
<body>
<a href="#departures">Skip to content</a>
<main id="departures" itemscope itemtype="https://schema.org/Trip">
<h1>Ferry timetable for the outer fjord</h1>
<section id="winter"><h2>Winter</h2>
<p>The boat leaves the town quay at six in the morning. It calls at three islands and turns at the last one. On Sundays the first trip
starts at nine. In strong wind the skipper may skip the outer stop. A note on the quay then tells you when the next boat runs.</p></section>
<section id="summer"><h2>Summer</h2>
<p>From June on there are two boats. They meet half way, so you can change from one to the other. The late trip runs until ten at night. Bring
a coat, as it gets cold on deck. Dogs may come along if they stay on a lead. The kiosk on board sells coffee, buns and maps of the paths.</p></section>
<section id="fares"><h3>Fares</h3>
<p>Pay on board or at the quay. Children under six ride free. A bike costs as much as a child. You may book a group of ten or more a week
ahead. We send a mail with the price. If the boat does not run, you get the fare back within a week.</p></section>
<form id="ask" action="/ask"><label>Your name <input autocomplete="name" id="who" name="who" type="text"></label>
<input aria-label="Phone number" autocomplete="tel" id="phone" name="phone" type="tel"><input id="send" type="submit" value="Ask for a group price"></form>
<img alt="Map of the three stops" id="map" src="stops.svg">
</main>
<nav id="more"><a data-testid="islands" href="/oyer">The islands</a></nav>
<footer id="foot">Fjord Ferries, town quay</footer>
</body>
</html>"""

# A control panel put together from containers only.
PANEL = (
    '<div class="w"><span onclick="p(1)" class="k">Start</span><div role="button" class="k">Stop</div><div onclick="p(2)"><span>Reset</span></div>'
    '<p>State: idle</p><select></select><input type="number"><textarea></textarea><img src="gauge.gif"><img src="lamp.gif"><img alt="x" src="led.gif">'
    '<iframe src="/log">' + "log line " * 20 + "</iframe></div>"
)

EMPTY_APP = "<!doctype html><html><head><title>Stock list</title></head><body><my-app></my-app><script src=app.js></script></body></html>"
FILLED_APP = (
    "<!doctype html><html><head><title>Stock list</title></head><body><my-app><h1>Stock by shelf</h1><h4>Shelf nine</h4>"
    "<ul><li>Forty boxes of screws that nobody has counted since the spring sale ended</li><li>Three ladders</li></ul>"
    + "".join(f'<a class="{c}" href="/shelf/{i}">Shelf number {i}</a>' for i, c in enumerate(("css-k3j2h1g", "css-q9w8e7r", "Row_cell__x7Yz2", "css-m4n5b6v")))
    + '<button class="css-z1x2c3v">Count again</button></my-app></body></html>'
)

CONSENT = (
    '<html><body><article><p>Weather for the week</p></article><section aria-modal="true" role="dialog"><h2>Sign in to go on</h2></section>'
    '<aside style="z-index: 12000; position: fixed; bottom: 0"><p>We ask for your consent to store cookies.</p></aside></body></html>'
)

TANGLE = (
    "<title>Odd &amp;  ends</title><section>few words</section><section id=big>" + "words of the big section. " * 12
    + "<style>b{}</style><script>skipped()</script></section><template><p>kept back</p></template><aside>left <nav>right</nav></aside>"
    "<p>first<p>second<i>slanted<!-- no <p>paragraph</p> --><textarea>1 < 2 &gt; 0</textarea>"
)

ROBOTS_OPEN = "Sitemap: https://ferje.example/kart.xml\nUser-agent: *\nDisallow: /intern/\nAllow: /\n"
ROBOTS_SHUT = "".join(
    f"User-agent: {b}\n" for b in ("GPTBot", "ClaudeBot", "ClaudeUser", "PerplexityBot", "Google-Extended", "CCBot", "anthropic-ai", "Bytespider")
) + "Disallow: /\n"
ROBOTS_TWO = "User-agent: *\nDisallow: /tmp\n\nUser-agent: PerplexityBot\nDisallow: /\n\nUser-agent: Bytespider\nDisallow: /\n"
LLMS_GOOD = "# Fjord Ferries\n> Boats between the islands\n\n## Tables\n- [Winter](https://ferje.example/w)\n- [Everything](https://ferje.example/llms-full.txt)\n"
LLMS_PROSE = "Boats run daily.\n"
SITEMAP_GOOD = '<?xml version="1.0" encoding="UTF-8"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>https://ferje.example/a.xml</loc></sitemap></sitemapindex>'
SITEMAP_BAD = "Not here"

QUICK = (90.0, 120_000, 12, 600.0, 1100.0)
TARDY = (2400.0, 9_000_000, 320, 9000.0, 21_000.0)

# name, final_url, raw, rendered, robots, llms, sitemap, perf
CASES = [
    ("timetable", "https://ferje.example/rutetabell", TIMETABLE, TIMETABLE, ROBOTS_OPEN, LLMS_GOOD, SITEMAP_GOOD, QUICK),
    ("panel", "http://panel.example/Unit/0123456789abcdef0123", PANEL, PANEL, ROBOTS_SHUT, LLMS_PROSE, SITEMAP_BAD, TARDY),
    ("app", "https://stock.example/list?sessionid=7", EMPTY_APP, FILLED_APP, ROBOTS_TWO, None, None, QUICK),
    ("consent", "https://weather.example/", CONSENT, CONSENT, None, None, None, QUICK),
    ("tangle", "https://tangle.example/odd-ends", TANGLE, TANGLE, " \n", "", None, QUICK),
    ("empty", "https://empty.example/", "", "", None, None, None, QUICK),
]
