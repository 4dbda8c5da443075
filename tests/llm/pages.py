"""Pages written by hand after common layouts, with the text of their articles, one line a block."""

_S = ["The river rose two metres over the night and flooded the lower fields.", "Farmers had moved their cattle to the hills the evening before.", "By noon the water had begun to fall, and the road was open again.", "Nobody was hurt, but three barns lost their roofs.", "The council will meet on Monday to speak about the dam."]


def _p(tag: str = "p", cls: str = "") -> str:
    return "".join(f"<{tag}{cls}>{s}</{tag}>" for s in _S)


_BODY = "\n".join(_S)
PAGES = {
    "blog": (f'<html><head><title>x</title></head><body class="home"><div id="page"><header id="masthead" class="site-header"><h1 class="site-title"><a href="/">My blog</a></h1><nav class="main-navigation"><ul><li><a href="/">Home</a></li><li><a href="/about">About</a></li></ul></nav></header><main id="main"><article class="post hentry"><h2 class="entry-title">The flood</h2><div class="entry-content">{_p()}</div></article><section id="comments" class="comments-area"><h3>2 comments</h3><ol class="comment-list"><li class="comment"><p>Glad you are all well!</p></li><li class="comment"><p>What about the bridge?</p></li></ol></section></main><aside id="secondary" class="widget-area"><h3>Recent posts</h3><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul></aside><footer class="site-footer">Powered by nothing. &copy; 2021</footer></div></body></html>', "The flood\n" + _BODY),
    "news": (f'<html><body><div class="cookie-banner"><p>We use cookies to make this site better.</p><button>Accept</button></div><div class="topbar"><a href="/s">Sport</a> | <a href="/w">World</a> | <a href="/m">Money</a></div><div class="wrapper"><div class="story"><h1>Flood in the valley</h1><div class="article-body">{_p()}</div><div class="ad-slot">Buy two lamps and get one free today</div><div class="share"><a href="#">Share</a><a href="#">Tweet</a></div></div><div class="sidebar"><h3>Most read</h3><ul><li><a href="/a">A dog that sings</a></li><li><a href="/b">Ten ways to cook rice</a></li></ul></div></div><div class="footer"><a href="/i">Imprint</a> <a href="/p">Privacy</a> &copy; News Ltd</div></body></html>', "Flood in the valley\n" + _BODY),
    "docs": ('<html><body><nav class="sidebar"><ul><li><a href="#a">Install</a></li><li><a href="#b">Use</a></li><li><a href="#c">Faults</a></li></ul></nav><main><h1>Guide</h1><h2>Install</h2><p>Unpack the archive and run the setup program as usual.</p><pre>make all</pre><h2>Use</h2><p>Start it from the menu, then open a file of your choice.</p><ul><li>Open shows a list of files.</li><li>Save writes the file at once.</li></ul><table><tr><td>Key</td><td>Action</td></tr><tr><td>F1</td><td>Help</td></tr></table></main><footer>Made with care</footer></body></html>', "Guide\nInstall\nUnpack the archive and run the setup program as usual.\nmake all\nUse\nStart it from the menu, then open a file of your choice.\nOpen shows a list of files.\nSave writes the file at once.\nKey Action\nF1 Help"),
    "plain": (f"<html><body><h1>Notes</h1>{_p()}</body></html>", "Notes\n" + _BODY),
    "table layout": (f'<html><body><table width="100%"><tr><td><a href="/">Home</a><br><a href="/x">News</a><br><a href="/y">Links</a></td><td class="content"><h1>Flood</h1>{_p()}</td></tr></table></body></html>', "Flood\n" + _BODY),
    "posts": ('<html><body><nav><a href="/">Home</a><a href="/a">About</a></nav><div class="content">' + "".join(f'<div class="post"><p>{s}</p></div>' for s in _S * 8) + "</div><footer>&copy; 2020</footer></body></html>", "\n".join(_S * 8)),
    "sections": ('<html><body><header><div class="logo">Acme</div><nav><a href="/1">Products</a> <a href="/2">Contact</a></nav></header><article>' + "".join(f"<section><h2>Part {i}</h2><p>{s}</p></section>" for i, s in enumerate(_S)) + '</article><form class="newsletter"><label>Your mail</label><input><button>Subscribe</button></form><footer><p>All rights reserved.</p></footer></body></html>', "\n".join(f"Part {i}\n{s}" for i, s in enumerate(_S))),
    "bare divs": ('<html><body><div class="menu"><a href="/">Start</a><a href="/k">Contact</a><a href="/q">Search</a></div><div id="content"><h1>Flood</h1>' + _p("div") + '</div><div class="footer">Contact us at any time. &copy; 2019</div></body></html>', "Flood\n" + _BODY),
    "icons": ('<html><body><nav><ul><li><a href="/">Home</a></li></ul></nav><main><h1>Flood</h1>' + "".join(f'<p>{s} <svg class="icon"/> See the map.</p>' for s in _S) + '<p>Choose <select><option>one<option>two</select> and go on.</p><p>Last <object data="x">no plugin</object> line of all.</p></main><footer>x</footer></body></html>', "Flood\n" + "\n".join(f"{s} See the map." for s in _S) + "\nChoose and go on.\nLast line of all."),
    "unclosed": (f'<body><div class=nav><a href=/>Home</a> <a href=/b>Back</a></div><article><h1>Flood<p>{"<p>".join(_S)}</article><aside><p>Read also: <a href=/z>The storm</a></p></aside>', "Flood\n" + _BODY),
    "references": ('<html><body><nav><a href="/">Home</a></nav><article><h1>Caf&eacute; &amp; bar</h1><p>It costs &lt; 5&nbsp;&euro; and   opens\n at&#32;8.</p><p>Tea &#x26; cake are served until four in the afternoon.</p></article><footer>&copy; Bar</footer></body></html>', "Café & bar\nIt costs < 5 € and opens at 8.\nTea & cake are served until four in the afternoon."),
    "nothing": ('<html><body><nav><a href="/">Home</a><a href="/a">About</a></nav><footer>&copy; 2020 Nobody</footer></body></html>', ""),
}
