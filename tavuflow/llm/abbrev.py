"""Short forms whose full stop seldom ends a sentence, shared by the sentence splitters."""

from __future__ import annotations

# Short forms (lower case, without their last stop) that stand before what they belong to.
INNER = """
prof dr doc doç bkz yrd uzm örn st mr mrs ms jr sr vs e.g i.e cf rev hon capt lt sgt
ks esim mm ts vrt huom yht
lásd pl ún id ifj özv u.n szerk vö
taz dk k.m mh mhe
t.ex bl.a d.v.s dvs jfr resp f.d
nt vt skp
məs bax akad t.e
डॉ श्री प्रो
""".split()

# Short forms that stand before a number.
NUMERIC = "s n nr no kb uk lk p pp u ca c vol fig kts sid str səh nu par art".split()

# Short forms that often end a list, and a sentence with it if a capital follows.
CLOSING = "vb vd jne jms yms ym stb n.k nk osv m.m m.fl etc jm jpm s".split()
