"""Pages whose main text was marked by hand: in each, what stands between ⟦ and ⟧ is main text."""

import re

PAGES = [
    """<html><body class="has-sidebar comments-open"><nav><ul><li><a href=/>Start</a><li><a href=/x>Stories</a></ul></nav>
<article><h1>⟦A day at the lake⟧</h1><p>⟦We left early, and the road was empty for the first hour of the trip.⟧</p>
<table><tr><th>⟦Place⟧</th><th>⟦Depth⟧</th></tr><tr><td>⟦North bay⟧</td><td>⟦12 m⟧</td></tr><tr><td>⟦The old mill, where the water is calm in summer⟧</td><td>⟦4 m⟧</td></tr></table>
<p>⟦By noon the wind came up, so that we had to turn back to the harbour.⟧</p></article>
<footer><p>Copyright by the lake club</p></footer></body></html>""",
    """<html><body class="single post logged-in"><header><p>The Daily</p></header><div class="ad">Buy two pay one</div>
<article><h1>⟦How to pack⟧</h1><p>⟦Packing well begins with a list of what the days will ask of you.⟧</p>
<ul><li>⟦socks⟧</li><li>⟦a map⟧</li><li>⟦bread⟧</li></ul><p>⟦Leave the rest at home, since every pound counts on the climb.⟧</p>
<ol><li>⟦Weigh it⟧</li><li>⟦Halve it⟧</li></ol></article><aside><h2>Most read</h2><ul><li><a href=/a>Ten boots</a></li><li><a href=/b>Old tents</a></li></ul></aside></body></html>""",
    """<html><body><div id="wrap"><nav><a href=/>Home</a></nav><article><section><h2>⟦First steps⟧</h2><p>⟦The engine is started by the lever on the left, never by the wheel.⟧</p></section>
<section><h2>⟦Care⟧</h2><p>⟦Oil it once in a month, and more often when it is in use each day.⟧</p>
<dl><dt>⟦Lever⟧</dt><dd>⟦The iron bar that starts the engine and stops it.⟧</dd><dt>⟦Wheel⟧</dt><dd>⟦Turns the mill.⟧</dd></dl></section></article>
<section class="comments"><h3>Comments</h3><div class="comment"><p>Mine broke after a week, a pity.</p></div><div class="comment"><p>Thanks for this, it helped me a lot with the old lever.</p></div></section></div></body></html>""",
    """<html><body class="home page"><div class="menu"><ul><li>News<li>Sport<li>Weather</ul></div><main><h1>⟦Rain over the hills⟧</h1>
<p>⟦Rain fell over the hills for the third day, and the brooks rose to the bridges.⟧</p><blockquote><p>⟦I have not seen it like this in years, said the miller.⟧</p></blockquote>
<p>⟦The town has set up beds in the school for those who cannot go home.⟧</p><pre>⟦gauge 3: 412 cm⟧</pre></main>
<div class="sidebar"><h3>Tags</h3><ul><li>rain</li><li>hills</li></ul></div><footer><table><tr><td>Imprint</td><td>Privacy</td></tr></table></footer></body></html>""",
    """<html><body class="no-js menu-closed"><div class="cookie-notice"><p>We store cookies on your device.</p><p>Accept all</p></div>
<div class="layout"><article><h1>⟦Bread without haste⟧</h1><h4>⟦What you need⟧</h4><table><tbody><tr><td>⟦Flour⟧</td><td>⟦500 g⟧</td></tr><tr><td>⟦Water⟧</td><td>⟦350 g⟧</td></tr></tbody></table>
<p>⟦Mix both and let them stand for a night, covered with a cloth.⟧</p><h4>⟦Baking⟧</h4><p>⟦Bake it hot for ten minutes, then gently until it sounds hollow.⟧</p></article>
<div class="related"><h4>You may like</h4><p><a href=/c>Soup for ten</a></p></div></div></body></html>""",
    """<html><body><form class="search"><p>Search this site</p></form><article><header><p>By a reader</p></header><h1>⟦The two ferries⟧</h1>
<p>⟦Two ferries cross the strait, one for people and one for carts and beasts.⟧</p><figure><img src=x><figcaption>⟦The larger ferry⟧</figcaption></figure>
<div><p>⟦The smaller one is older, and faster when the tide runs out.⟧</p></div><div class="share"><p>Tell a friend</p></div><p>⟦Neither sails at night.⟧</p></article></body></html>""",
]


def marked(page):
    """The page without its marks, and the blocks between them, white space as in the output."""
    inside = [" ".join(x.split()) for x in re.findall("⟦(.*?)⟧", page, re.S)]
    return page.replace("⟦", "").replace("⟧", ""), inside
