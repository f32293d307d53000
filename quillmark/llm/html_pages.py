"""Labelled pages that the HTML extractor learns from, hand-written.

``data-main`` marks a subtree as content and ``data-rest`` as anything else;
the root is not content. The texts do not matter, only tags, names and links.
"""

PAGES = [
    """<html><head><title>t</title><script>x</script></head><body><nav><ul><li><a href=1>one</a></li><li><a href=2>two</a></li></ul></nav>
    <div class="ad">buy this</div><article data-main><h1>title</h1><p>first text</p><p>more text</p><p>end</p></article><footer>copyright</footer></body></html>""",
    """<html><body><header><div class="logo">site</div><nav class="main-menu"><ul><li><a href=1>one</a></li></ul></nav></header>
    <main data-main><article><header><h1>title</h1></header><p>text</p><blockquote><p>said</p></blockquote><ul><li>point</li><li>point</li></ul><p>text</p>
    <div class="share social" data-rest><a href=1>share</a></div></article></main>
    <aside class="sidebar" data-rest><div class="widget"><h3>related</h3><ul><li><a href=1>other</a></li></ul></div></aside><footer class="site-footer"><p>legal</p></footer></body></html>""",
    """<html><body><div id="page"><div id="header"><h1><a href=0>site</a></h1></div><div id="content" data-main><div class="post"><h2>title</h2><div class="entry-content"><p>text</p><p>text</p>
    <table><tr><th>k</th><td>v</td></tr></table><h3>part</h3><p>text</p><pre>code</pre></div></div></div><div id="sidebar"><h3>archives</h3><ul><li><a href=3>may</a></li></ul></div><div id="footer"><p>powered</p></div></div></body></html>""",
    """<html><body><div class="cookie-notice">we use cookies<button>ok</button></div><div class="container"><div class="breadcrumbs"><a href=1>home</a></div>
    <div class="article-body" data-main><h1>title</h1><p>text <a href=2>link</a> text</p><figure><figcaption>caption</figcaption></figure><p>text</p><div class="advert" data-rest>ad</div><p>text</p></div>
    <section class="comments"><h3>comments</h3><ol class="comment-list"><li class="comment"><p>great</p></li><li class="comment"><p>no</p></li></ol><form><p>reply</p></form></section></div></body></html>""",
    """<html><body><div role="banner">site</div><div role="navigation"><a href=1>a</a></div><div role="main" data-main><section><h2>title</h2><p>text</p><dl><dt>k</dt><dd>v</dd></dl></section><section><h2>part</h2><p>text</p></section></div>
    <div role="complementary"><p>more</p></div><div role="contentinfo"><p>imprint</p></div></body></html>""",
    """<html><body><div class="topbar"><form class="search"><p>find</p></form><ul class="menu"><li><a href=1>x</a></li></ul></div><div class="main" data-main><div class="story"><h1>title</h1><div class="text"><p>text</p><p>text</p></div></div></div>
    <div class="newsletter"><h4>subscribe</h4><p>every week</p></div><div class="related-posts"><h4>more</h4><ul><li><a href=4>x</a></li></ul></div><div class="popup modal"><p>sale</p></div></body></html>""",
    """<html><body><header>site<nav><a href=1>a</a><a href=2>b</a></nav></header><article data-main><h1>title</h1><p>text</p><aside class="ad-slot sponsored" data-rest><p>ad</p></aside><p>text</p><ol><li>step</li><li>step</li></ol><p>text</p><footer data-rest><p>tags</p></footer></article>
    <div id="disqus_thread" class="comments-area"><div class="comment-body"><p>hi</p></div></div><footer><ul><li><a href=1>terms</a></li></ul></footer></body></html>""",
    """<html><body><nav class="navbar"><div><a href=1>a</a></div></nav><div class="alert notice"><p>outage</p></div><div id="main-content" class="page-content" data-main><p>text</p><p>text</p><h2>part</h2><p>text</p><p>text</p></div><div class="pagination"><a href=2>next</a></div><div class="banner promo"><p>offer</p></div><div class="copyright"><p>all</p></div></body></html>""",
    """<html><body><table><tr><td class="menu"><a href=1>a</a></td><td data-main><h1>title</h1><p>text</p><p>text</p></td></tr></table><div class="ads"><p>ad</p></div></body></html>""",
    """<html><body data-main><h1>title</h1><p>text</p><p>text</p><p>text</p></body></html>""",
    """<html><body><p data-main>text</p><p data-main>text</p><div class="ad" data-rest>ad</div><footer data-rest>end</footer></body></html>""",
    """<html><body><header class="site-header"><h2>site</h2></header><article class="post" data-main><h1>title</h1><div class="entry"><p>text</p><p>text</p><p>text</p></div></article><section id="comments" class="responses"><article class="comment"><p>me too</p></article><div id="respond"><form><p>say</p></form></div></section><aside><div class="widget"><p>poll</p></div></aside><footer><div class="legal"><p>c</p></div></footer></body></html>""",
    """<html><body><h1 data-main>title</h1><p data-main>text</p><p data-main>text</p><p data-main>text</p><p data-main>text</p><p data-main>text</p><p data-main>text</p>
    <form><p>name</p></form><section class="comments"><p>hi</p></section><aside><p>more</p></aside><footer><p>end</p></footer></body></html>""",
    """<html><body><article data-main><h1>title</h1><p>text</p><p><a href=1>linked paragraph</a></p><p>text</p><ul><li>see <a href=2>one</a></li><li><a href=3>two</a></li></ul><p>text</p>
    <section class="comments" data-rest><h2>comments</h2><p>hi</p><ol><li>me</li></ol></section></article></body></html>""",
    """<html><body><div class="content" data-main><h2>title</h2><p>text</p><div class="comments" data-rest><div class="comment"><p>yes</p></div><div class="comment"><p>no</p></div></div></div></body></html>""",
    """<html><body><article data-main><p>text</p><form data-rest><p>name</p><div>mail</div></form><p>text</p><div class="promo" data-rest><p>offer</p></div><p>text</p><section class="ad-break" data-rest><p>ad</p></section><p>text</p></article></body></html>""",
    """<html><body><div data-main><h1>title</h1><p>text</p><p>text</p></div><div class="sidebar"><p>about</p><ul><li><a href=1>x</a></li></ul></div></body></html>""",
    """<html><body><div data-main><p>text</p><p>text</p><p>text</p></div><div class="footer"><p>c</p></div></body></html>""",
    """<html><body><div class="header"><p>site</p></div><div><div data-main><h1>title</h1><p>text</p><div>text</div><p>text</p></div><div class="sidebar"><p>about</p></div></div></body></html>""",
    """<html><body data-main>text<br>text<br>text</body></html>""",
    """<html><body data-main><h1>title</h1>text<p>text</p>text<ul><li><a href=1>one</a></li><li>two</li></ul></body></html>""",
    """<html><body data-main>text <a href=1>link</a> text<nav data-rest><a href=1>a</a></nav><div class="ad" data-rest>ad</div></body></html>""",
    """<html><body><main data-main><h1>title</h1><p>text</p><h2>sources</h2><ul><li><a href=1>one</a></li><li><a href=2>two</a></li><li><a href=3>three</a></li></ul><p>text</p><div class="newsletter signup" data-rest><h3>join</h3><form><p>mail</p></form></div>
    <aside class="related" data-rest><h3>more</h3><ul><li><a href=4>x</a></li></ul></aside><p>text</p><div class="author-bio byline" data-rest><p>the author</p></div></main></body></html>""",
    """<html><body><div id="wrapper"><div class="nav"><a href=1>a</a></div><article data-main><h1>title</h1><div class="meta" data-rest><a href=2>tag</a></div><p>text</p><figure><figcaption>text</figcaption></figure><blockquote>text</blockquote><table><tr><td>k</td><td>v</td></tr></table>
    <div>text</div><div>text</div><div class="sponsored" data-rest><div>ad</div></div><div id="comments" data-rest><h3>replies</h3><div><p>ok</p></div></div></article></div></body></html>""",
    """<html><body><section class="hero banner"><h2>welcome</h2></section><section data-main><h2>title</h2><p>text</p><p>text</p></section><section class="subscribe"><p>join us</p></section><section class="reader-comments"><p>nice</p></section></body></html>""",
    """<html><body><div class="cookie consent"><p>cookies</p></div><div data-main><p>text</p><p><a href=1>link</a></p><dl><dt>k</dt><dd>v</dd></dl><pre>code</pre></div><div role="search"><p>find</p></div><div class="toolbar"><a href=1>print</a></div></body></html>""",
    """<html><body><article data-main><header><h1>title</h1></header><section><h2>part</h2><p>text</p></section><section><h2>part</h2><p>text</p><ol><li><p>step</p></li></ol></section><footer data-rest><p>filed</p></footer>
    <div class="discussion" data-rest><article><p>first!</p></article></div></article><div class="promo-box"><p>deal</p></div></body></html>""",
    """<html><body><ul class="menu"><li><a href=1>a</a></li><li><a href=2>b</a></li></ul><h1 data-main>title</h1><p data-main>text</p><ul data-main><li>see <a href=1>x</a></li><li><a href=2>y</a></li></ul><p data-main>text</p><div data-main>text</div><ul class="links"><li><a href=1>c</a></li></ul></body></html>""",
    """<html><body><div class="menu"><a href=1>a</a></div><p data-main>text</p><p data-main>text</p><footer>end</footer></body></html>""",
    """<html><body><div class="top"><a href=1>a</a> <a href=2>b</a></div><h2 data-main>title</h2><p data-main>text</p><p data-main>text</p><p data-main>text</p><div class="bottom"><a href=1>c</a></div></body></html>""",
    """<html><body><nav><a href=1>a</a></nav><p data-main>text</p><p data-main>text</p><blockquote data-main>text</blockquote><hr><div class="comments"><h2>comments</h2><h3>someone</h3><p>hi</p><h3>other</h3><p>ho</p></div></body></html>""",
    """<html><body><article data-main><h1>title</h1><p>text</p><section id="comments" data-rest><h2>responses</h2><h4>someone</h4><p>hi</p></section><div class="related" data-rest><h2>read on</h2><h3><a href=1>x</a></h3></div></article>
    <aside><h2>about</h2><p>us</p></aside><div class="footer"><h4>contact</h4><p>mail</p></div><section class="promo"><h1>sale</h1><h2>now</h2></section></body></html>""",
    """<html><body><div class="banner"><h1>offer</h1></div><div class="widget"><h2>poll</h2><h3>vote</h3></div><div data-main><h2>title</h2><p>text</p><ul><li><a href=1>one</a></li><li><a href=2>two</a></li></ul><p>text</p></div><div class="comment"><h2>x</h2><h3>y</h3><p>z</p></div></body></html>""",
    """<html><body><section data-main><h2>title</h2><p>text</p></section><section data-main><h2>part</h2><p>text</p></section><footer><p>end</p></footer></body></html>""",
    """<html><body><header><h1>site</h1></header><section data-main><h1>title</h1><p>text</p><h2>part</h2><p>text</p></section><section class="newsletter"><h2>join</h2><p>weekly</p></section></body></html>""",
    """<html><body><div><div class="nav"><a href=1>a</a></div><div class="post" data-main><h2>title</h2><div class="entry"><p>text</p></div></div><div id="comments"><h2>said</h2><ol><li>one</li><li>two</li></ol></div></div></body></html>""",
    """<html><body><section data-main><h2>title</h2><ul><li>text</li><li>text</li></ul><p>text</p></section><section id="comments"><ul><li>one</li><li>two</li><li>three</li></ul></section></body></html>""",
    """<html><body><div data-main><h3>title</h3><p>text</p><h3>part</h3><p>text</p></div><div class="comments"><h3>said</h3><ol><li>me</li></ol></div></body></html>""",
]
