"""Labelled pages: data-label="1" marks where main text begins, data-label="0" what inside or beside it is none."""

_P = "The committee met on Tuesday, and after a long debate it agreed to publish the figures. Nobody had expected that, said one of the members; the report had been ready since spring."
_Q = "Rain fell for most of the week. By Friday the lower road was closed, so the bus took the way over the hill, which is longer but safer in such weather."
_S = "A short remark, no more."

# Pages of common layouts, labelled by hand.
LABELLED = [
    f'<html><head><title>x</title></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/a">News</a></li><li><a href="/b">Sport</a></li></ul></nav><div class="ad">{_S}</div><article data-label="1"><h1>What the report says</h1><p>{_P}</p><p>{_Q}</p><p>{_S}</p></article><footer>&copy; example.com &middot; {_S}</footer></body></html>',
    f'<html><body><div class="cookie-notice"><p>We use cookies to make this site work. Accept them, or read more.</p><button>OK</button></div><header><h1>Example Times</h1><p>News of the day</p></header><main data-label="1"><h1>Roads closed</h1><p>{_Q}</p><p>{_P}</p><ul><li>{_S}</li><li>The hill road stays open.</li></ul></main><aside><h3>Most read</h3><ul><li><a href="/1">Roads closed</a></li><li><a href="/2">What the report says</a></li></ul></aside><footer><p>All rights reserved.</p></footer></body></html>',
    f'<html><body><div id="menu"><a href="/">Start</a> <a href="/x">Archive</a></div><div class="wrap"><div class="post-content" data-label="1"><h2>A week of rain</h2><p>{_Q}</p><p>{_Q}</p><blockquote>{_P}</blockquote><div class="share-buttons" data-label="0"><a href="/t">Share</a> <a href="/f">Send</a></div></div><div class="sidebar"><h4>About</h4><p>{_S}</p><p>{_P}</p></div></div><div class="footer">Copyright 2020 Example</div></body></html>',
    f'<html><body><nav class="breadcrumb"><a href="/">Home</a> &gt; <a href="/n">News</a></nav><article data-label="1"><h1>Figures at last</h1><p>{_P}</p><p>{_P}</p><p>{_Q}</p></article><section class="comments" id="comments"><h3>Comments</h3><div class="comment"><p>I was there, and it was not like that at all. They never read the report.</p></div><div class="comment"><p>{_Q}</p></div><form class="reply-form"><p>Leave a reply</p><textarea></textarea></form></section><footer>{_S}</footer></body></html>',
    f'<html><body><div class="topbar">Call us today!</div><div id="content" data-label="1"><h1>How the bus goes now</h1><p>{_Q}</p><div class="advert" data-label="0"><p>{_S} Buy two, get one free.</p></div><p>{_P}</p><h2>Times</h2><table><tr><td>Monday</td><td>nine, and again at ten</td></tr></table><p>{_S}</p></div><div class="related"><h3>Related</h3><ul><li><a href="/1">A week of rain</a></li><li><a href="/2">Figures at last</a></li></ul></div></body></html>',
    f'<html><body><div><a href="/">Home</a><a href="/n">News</a><a href="/c">Contact</a></div><div data-label="1"><h1>Plain page</h1><p>{_P}</p><p>{_P}</p><p>{_Q}</p></div><div>&copy; Example Ltd</div></body></html>',
    f'<html><body><header class="site-header"><a href="/">Example</a></header><div class="newsletter"><p>Subscribe to our letter, once a week.</p><form><input></form></div><section class="entry" data-label="1"><h1>On the hill</h1><p>{_Q}</p><figure><img src="a.png"><figcaption>The hill, seen from the road.</figcaption></figure><p>{_P}</p><ol><li>{_P}</li><li>{_Q}</li></ol><p>{_S}</p></section><div class="comment-list"><p>{_S}</p><p>{_P}</p></div><footer><ul><li><a href="/p">Privacy</a></li><li><a href="/t">Terms</a></li></ul></footer></body></html>',
    f'<html><body><div class="modal popup"><h2>Wait!</h2><p>{_S}</p></div><table><tr><td><a href="/">A</a><br><a href="/b">B</a></td></tr></table><div class="story" data-label="1"><h1>{_S}</h1><p>{_S}</p><p>{_S}</p><p>{_Q}</p><pre>one two three</pre></div><div class="pagination"><a href="/1">1</a> <a href="/2">2</a></div></body></html>',
]
