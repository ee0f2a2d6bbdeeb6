"""The labelled table of the markup classifier: texts as (line or span, labels of the blocks it gives)."""

T, H, L, C, F, N = "text", "heading", "list_item", "code", "formula", "none"

LABELLED: list[list[tuple[str, str]]] = [
    [  # wiki text
        ("The old mill stands near the river and its [[weir]] is '''long'''.", T),
        ("== History ==", H),
        ("It was built in [[1802]] by a guild of millers from the north.", T),
        ("# first stone of the weir", L),
        ("# second stone", L),
        ("#third stone of the weir", L),
        ("=== Early years===", H),
        ("* grain", L),
        ("** rye of the hills", L),
        ("**oats", L),
        ("*barley", L),
        ("Here <math>a+b</math> holds for all mills.", f"{T} {F}"),
        ("<math display=\"block\">x^2</math>", F),
        ("<pre>\nif a == b:\n</pre>", C),
        ("Entry costs $4 or $10 a day.", T),
        ("[[Category:Mills]]", N),
        ("__NOTOC__", N),
        ("See [[a]], [[b]] and [[c]] for more on it.", T),
    ],
    [
        ("'''Mills''' turn slowly in the valley of the [[river]].", T),
        ("#one lonely item", L),
        ("The form <nowiki>[[x]]</nowiki> is obsolete.", T),
        ("**deep item of the list", L),
        ("==External links==", H),
        ("[[File:Mill.jpg|thumb|left|A [[mill]] seen from the north]]", N),
        ("<syntaxhighlight lang=\"c\">\nint x;\n</syntaxhighlight>", C),
        ("----", N),
        ("The '''end''' of the text.", T),
    ],
    [
        ("A text of [[links]] with one list of a single line.", T),
        ("# lonely item in a wiki", L),
        ("The ''last'' sentence ends here, see [[there]].", T),
        ("## nested lonely item", L),
        ("", ""),
        ("==== Deep heading ====", H),
        ("<source lang=\"sql\">\nSELECT 1\n</source>", C),
        ("Under the charter, every ''mill'' paid 3 measures.", T),
        ("# Upper-case item of a list", L),
        ("# Another one, with [[link]]", L),
    ],
    [
        ("A short text without any markup at all stands here.", T),
        ("# first item of the list", L),
        ("# second item of the list", L),
        ("Another line of plain text without markup follows.", T),
    ],
    [
        ("Plain words only, and then a list with stars.", T),
        ("* first", L),
        ("** second", L),
        ("*third", L),
        ("Plain words end the text.", T),
    ],
    [
        ("A plain text with one item.", T),
        ("# eastern item of the plain", L),
        ("It ends in a plain sentence.", T),
    ],
    [
        ("#REDIRECT [[Other page]]", N),
    ],
    [  # HTML
        ("<p>The old <b>mill</b> stands near the <a href=\"https://x.example/r\">river</a>.</p>", T),
        ("<h2 id=\"s1\">History</h2>", H),
        ("<ul>", N),
        ("<li>grain of the north</li>", L),
        ("<li>rye of the hills", L),
        ("</ul>", N),
        ("<p>Here \\(a+b\\) holds.</p>", f"{T} {F}"),
        ("\\[x^2 + 4\\]", F),
        ("<pre class=\"x\">\n# rows\n</pre>", C),
        ("<pre><code>&lt;li>a&lt;/li></code></pre>", C),
        ("<H3>Later <em>years</em></H3>", H),
        ("<p>It costs $3 or $5 a day in the <b>mill</b>.</p>", T),
        ("Engineers inherited the mill without a paragraph mark.", T),
    ],
    [
        ("<ol>", N),
        ("<li>one of two", L),
        ("<li>two of two", L),
        ("</ol>", N),
        ("<p>The end, which is <em>near</em>.</p>", T),
        ("<h1>Title of it all</h1>", H),
        ("Plain line of text in a page.", T),
    ],
    [  # Markdown
        ("The old **mill** stands near the [river](https://x.example/r).", T),
        ("", ""),
        ("## History", H),
        ("", ""),
        ("- grain of the north", L),
        ("- rye", L),
        ("  - oats of the hills", L),
        ("+ barley", L),
        ("* wheat of the south", L),
        ("  * spelt", L),
        ("1. first of three", L),
        ("2. second of three", L),
        ("", ""),
        ("**Several** sources mention the mill.", T),
        ("", ""),
        ("Later years", H),
        ("-----------", N),
        ("", ""),
        ("The whole story", H),
        ("===============", N),
        ("", ""),
        ("Here $a+b$ holds and _nothing_ else.", f"{T} {F}"),
        ("$$x^2$$", F),
        ("$$\np < 0.05\n$$", F),
        ("```sql\n# rows\n```", C),
        ("~~~c\nint x;\n~~~", C),
        ("", ""),
        ("### Naming ##", H),
        ("", ""),
        ("| a | b |", N),
        ("|---|---|", N),
        ("| c | 4 |", N),
        ("It lists 3 \\* 4 plots and costs $4 or $10 a day.", T),
        ("*Nobody* knows the mill.", T),
    ],
    [
        ("A mill with ~~one~~ two wheels and `code` in it.", T),
        ("", ""),
        ("# The heading of all", H),
        ("", ""),
        ("It has **much** text under it, see [here](https://x.example).", T),
        ("", ""),
        ("#### Deep one", H),
        ("", ""),
        ("Here $\\frac{E}{V}$ holds, $p < 0.05$ too.", f"{T} {F} {F}"),
        ("", ""),
        ("# lower heading of a page", H),
        ("", ""),
        ("The **end** of it.", T),
    ],
    [
        ("Short text.", T),
        ("", ""),
        ("## Legacy ##", H),
        ("", ""),
        ("Nothing more of it.", T),
        ("", ""),
        ("### See also", H),
    ],
    [
        ("Plain text, then a list.", T),
        ("", ""),
        ("- one of the plain", L),
        ("- two of the plain", L),
        ("", ""),
        ("Here $d(v)+1$ holds.", f"{T} {F}"),
        ("More plain text.", T),
    ],
    [
        ("Plain text, then numbers.", T),
        ("", ""),
        ("1. one of the plain", L),
        ("2. two of the plain", L),
        ("+ three of the plain", L),
        ("", ""),
        ("More plain text.", T),
    ],
    [
        ("# Field notes", H),
        ("", ""),
        ("A short note about the mills of the valley.", T),
        ("", ""),
        ("## Install", H),
        ("", ""),
        ("Run this once.", T),
        ("", ""),
        ("    mill --help\n    mill run", C),
        ("", ""),
        ("- one of the plain", L),
        ("- two of the plain", L),
    ],
    [
        ("# Mills", H),
        ("- one of them", L),
        ("- two of them", L),
        ("", ""),
        ("#Rivers", H),
        ("", ""),
        ("Nothing is known about **rivers** here.", T),
        ("", ""),
        ("> A quoted line of text.", T),
        ("> - quoted item", L),
    ],
    [
        ("# Notes on the weir", H),
        ("", ""),
        ("The weir was built by hand.", T),
    ],
    [
        ("# Change log", H),
        ("## Version two", H),
        ("* more wheels", L),
        ("* fewer stones", L),
        ("### Older ones", H),
        ("1. first of all", L),
        ("2. second of all", L),
        ("", ""),
        ("Call `mill` to start.", T),
        ("", ""),
        ("\tmill start", C),
    ],
    [
        ("Weir of the north", H),
        ("=================", N),
        ("", ""),
        ("Some words stand under the title.", T),
        ("", ""),
        ("Early days", H),
        ("----------", N),
        ("", ""),
        ("* grain of the north", L),
        ("* rye of the hills", L),
        ("", ""),
        ("#Naming", H),
        ("", ""),
        ("See [the map](https://x.example/m) of it.", T),
    ],
    [
        ("# Introduction", H),
        ("Words follow right below.", T),
        ("", ""),
        ("Done.", T),
        ("", ""),
        ("# Tasks", H),
        ("* [ ] one", L),
        ("* [x] two", L),
        ("", ""),
        ("Use it.", T),
        ("", ""),
        ("    x = 1\n    y = 2", C),
        ("", ""),
        ("Yes.", T),
    ],
    [
        ("# Reference", H),
        ("", ""),
        ("Gives `None`.", T),
        ("", ""),
        ("## `get`", H),
        ("", ""),
        ("Short words:", T),
        ("", ""),
        ("    get(x)", C),
        ("", ""),
        ("Short words.", T),
        ("## B", H),
        ("words", T),
        ("### C", H),
        ("- x", L),
    ],
    [
        ("Head", H),
        ("====", N),
        ("", ""),
        ("words here", T),
        ("", ""),
        ("Sub", H),
        ("---", N),
        ("", ""),
        ("* a", L),
        ("* b", L),
        ("", ""),
        ("end", T),
    ],
    [
        ("# Head", H),
        ("", ""),
        ("Words.", T),
        ("", ""),
        ("# Other head", H),
        ("", ""),
        ("See:", T),
        ("", ""),
        ("    run\n    stop", C),
        ("", ""),
        ("> # Quoted head", H),
        ("> quoted words", T),
    ],
    [
        ("# Porridge", H),
        ("", ""),
        ("- oats", L),
        ("- salt", L),
        ("", ""),
        ("1. stir", L),
        ("2. boil", L),
        ("10. eat", L),
        ("", ""),
        ("Enjoy.", T),
    ],
    [  # short wiki texts
        ("'''Mill''' is a [[thing]].", T),
        ("# One", L),
        ("# Two", L),
        ("== See also ==", H),
        ("# Three of [[four]]", L),
    ],
    [
        ("'''Weir''' is a [[thing]].", T),
        (":* a", L),
        (":* b", L),
        ("::# c", L),
        (": reply", T),
        ("Yes, ''done''.", T),
        ("* [[One]]", L),
        ("# Two", L),
    ],
    [
        ("'''Dam''' was a [[thing]].", T),
        ("# One", L),
        ("# Two", L),
    ],
    [  # wiki text with empty lines
        ("The '''weir''' is described in [[Mill]].", T),
        ("", ""),
        ("# Item of a list with [[link]]", L),
        ("# Second item of it", L),
        ("", ""),
        (":* item under an indent", L),
        ("::# deeper item", L),
        (": an indented reply of a talk page", T),
        ("", ""),
        ("#tight item", L),
        ("", ""),
        ("The ''end'' of it.", T),
    ],
    [  # TeX
        ("The old \\textbf{mill} stands near the \\emph{river}.~\\cite{mill}", T),
        ("\\section{History}", H),
        ("\\label{sec:history}", N),
        ("\\begin{itemize}", N),
        ("\\item grain of the north", L),
        ("\\item rye", L),
        ("\\end{itemize}", N),
        ("Here $a+b$ holds.", f"{T} {F}"),
        ("\\begin{equation*}\nx^2\n\\end{equation*}", F),
        ("\\[ \\alpha \\le 3 \\]", F),
        ("\\begin{verbatim}\n# rows\n\\end{verbatim}", C),
        ("\\begin{lstlisting}\nint x;\n\\end{lstlisting}", C),
        ("\\subsection*{Later years}", H),
        ("Entry costs \\$9, or 5\\% less.\\footnote{See Mill.}", T),
    ],
    [
        ("\\emph{The} mill of the text has \\textbf{wheels}.", T),
        ("\\subsection{Naming of it}", H),
        ("\\begin{enumerate}", N),
        ("\\item first", L),
        ("\\item second of two", L),
        ("\\end{enumerate}", N),
        ("Here $O(V+E)$ holds and $n$ too.", f"{T} {F} {F}"),
        ("\\begin{verbatim}\nSELECT title FROM pages -- ## all\n\\end{verbatim}", C),
        ("\\begin{equation}\nn(n-1)/2\n\\end{equation}", F),
    ],
]
