"""Small pages, written for this engine, that hold what the shipped ``pages`` table lacks: contacts, people, structured data.

Queries parse them beside the shipped table; what they must yield is written down in ``gleaner/expected.py``.
"""

from __future__ import annotations

_KEY = 0x5A


def protected(text: str) -> str:
    """A text behind a hexadecimal code that begins with its key."""
    return bytes([_KEY, *(b ^ _KEY for b in text.encode())]).hex()


LISTING = """<html><head><title>Harbour logistics firms</title></head><body>
<ul><li><a href="/company/kestrel-freight?rating=5">Kestrel</a> <a href="/company/kestrel-freight">reviews</a></li>
<li><a href="//www.goodfirms.co/company/morrow-lines/">Morrow Lines</a></li>
<li><a href="https://elsewhere.example/company/not-here">Elsewhere</a></li><li><a href="mailto:desk@goodfirms.co">write</a></li></ul>
<nav><a rel="prev" href="?page=2">back</a> <a class="pager-next" href="?page=4">4</a> <a href="/directory/harbour-logistics?page=9">&rarr;</a> <a class="next" href="/blog?page=2">blog</a></nav>
</body></html>"""

PROFILE = f"""<html><body>
<div class="top"><h1 class="header-company_name">Kestrel Freight</h1><a href="https://www.linkedin.com/company/kestrel-freight/?x=1">in</a> <a href="https://x.com/intent/tweet">share</a> <a href="https://x.com/kestrelfreight?lang=en">x</a></div>
<div class="field-service">Road &amp; Rail-60%WarehousingHubs-40%</div>
<table><tr><th>Team size</th><td>50 - 249</td></tr><tr><th>Founded</th><td>1998</td></tr></table>
<p><a rel="noopener" href="https://clutch.co/redirect?u=https%3A%2F%2Fwww.kestrel-freight.example.com%2F">Official site</a> <a href="https://facebook.com/kestrel">website on Facebook</a></p>
<section><p>Write to quotes@kestrel-freight.example.com or call +44 20 7946 0018.</p></section>
<section><span>Olga Brandt, Director of Operations</span> <a href="mailto:olga_brandt@depot.example.com?subject=Hi">mail</a> <a href="https://uk.linkedin.com/in/olga-brandt">profile</a> <a href="tel:(212) 555-0142">call</a></section>
<section>A client wrote from someone@client.example.org</section>
</body></html>"""

PROFILE_BY_SAME_AS = """<html><body><h1>Morrow Lines</h1>
<script type="application/ld+json">{"@graph": [{"@type": "WebSite", "name": "x"}, {"@type": ["Thing", "LocalBusiness"], "name": "Morrow Lines Ltd", "sameAs": ["https://twitter.com/morrowlines", "https://morrow-lines.example.net/start"], "numberOfEmployees": {"minValue": 11.0, "maxValue": 50}, "knowsAbout": ["Ferries", "Port services"], "description": "Ferries since 1971", "foundingDate": 1971, "address": {"addressLocality": "Bergen", "addressCountry": "NO"}}]}</script>
<script type="application/ld+json">{not json</script></body></html>"""

PROFILE_WITHOUT_SITE = """<html><body><h1>Nobody Knows</h1><p>hello@nobody.example.com</p><a href="/agency/other">other</a></body></html>"""

SITE = f"""<html><head><title>Larkspur Instruments | Precision</title><meta property="og:site_name" content="Larkspur Instruments">
<link rel="stylesheet" href="/wp-content/themes/a.css"><script src="https://js.hs-scripts.com/1.js"></script>
<script type="application/ld+json">[{{"@type": "Organization", "url": "https://larkspur.example.com", "industry": "Optics; Sensors", "numberOfEmployees": 120, "contactPoint": [{{"telephone": "+49 30 901820"}}, {{"telephone": "+49 30 9018 2000"}}]}}]</script></head>
<body><p>We moved from Shopify and Laravel.</p> <a href="https://cdn.shopify.com/x">shop</a>
<a href="/about/">About</a> <a href="team/people?ref=nav&amp;utm_source=top">People</a> <a href="/files/price.pdf">Prices</a> <a href="#top">Top</a> <a href="https://www.larkspur.example.com/products/lens">Lens</a> <a href="https://other.example.org/about">Other</a>
<table><tr><td>Ivo Marek, Head of Research, ivo.marek@larkspur.example.com, tel. +420 601 123 456</td></tr>
<tr><td>Sales <a data-cfemail="{protected('Sales@Larkspur.example.com')}">[protected]</a></td></tr></table>
<div><p>press [at] larkspur [dot] example.com</p></div>
<section>annalee2@mail.larkspur.example.com or noname77@larkspur.example.com or rita@gmail.com</section>
<footer><a href="https://www.linkedin.com/company/larkspur-instruments">in</a></footer></body></html>"""

TEAM = f"""<html><head><title>Team - Tern &amp; Tide</title><meta name="generator" content="gatsby-5"></head><body><h2>Our Team</h2>
<div><h4>RUTH MCALLISTER</h4><span>Chief Financial Officer</span><a href="https://linkedin.com/in/ruth-mcallister/">in</a></div>
<div><strong>Dr. Ben Okafor</strong><p>Lead of nothing in particular, but Marketing Manager by day</p></div>
<div><h3>Ruth McAllister</h3><p>Founder, mentioned again</p></div>
<div><h3>Ada Quill</h3><p>Enjoys long walks</p></div>
<div><b>Jo Lind</b><div><p>Partner, Hamburg office</p></div></div>
<p>{'We keep boats afloat and papers in order. ' * 10}</p>
</body></html>"""

GONE = """<html><head><title>Harbour firms</title></head><body><p>This profile not found, sorry.</p></body></html>"""
MISSING = """<html><head><title>Error 404</title></head><body></body></html>"""
LONG = f"""<html><head><title>Stories</title></head><body><p>The page you are looking for was found. {'We sail. ' * 400}</p></body></html>"""

#: (url, html)
PAGES = [
    ("https://goodfirms.co/directory/harbour-logistics?page=3", LISTING),
    ("https://clutch.co/profile/kestrel-freight", PROFILE),
    ("https://www.designrush.com/agency/morrow-lines", PROFILE_BY_SAME_AS),
    ("https://www.designrush.com/agency/nobody", PROFILE_WITHOUT_SITE),
    ("https://www.larkspur.example.com/contact", SITE),
    ("https://terntide.example.com/team", TEAM),
    ("https://terntide.example.com/gone", GONE),
    ("https://terntide.example.com/missing", MISSING),
    ("https://terntide.example.com/stories", LONG),
    ("https://terntide.example.com/empty", None),
]
