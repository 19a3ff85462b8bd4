"""Texts of the kinds that were missed or flagged by mistake in round 2, in words of their own; none is a sentence of a table.

They were written before the rows of this round, by the same hand, after its misses in the tables had been read. Their own misses
were read once while rows were added, so they measure nothing on unseen text.
"""

ABUSIVE = """Hiring refugees was a mistake, their sort spoils whatever it touches.
Another patch from one of those migrants? Throw it away and throw them out with it.
The best part about Muslims is when they finally drop dead.
If we lose the gypsies we lose nothing, so let us keep the nation pure.
We should build a fence round the immigrants because that lot destroys everything.
Foreigners are too stupid to use the scheduler, keep them off the team.
I refuse to merge anything from lesbians because they are not right in the head.
Lowlanders are filth and ought to be locked up.
The hill people steal and lie, all of them.
New Zealanders are too thick for this job and must be kept away from it.
Never let marsh people near the build, their sort ruins everything.
Who wrote this, a woman? Bin it, and bin her as well.
kys already, dave
kys_bot42 is right for once: kys rosa, nobody will care
Webcam babe, topless, private chat for everybody who tips.
Naked student on cam, live show for 20 coins, come and watch.
you p***e of s**t, leave us alone
What a s**k of s**t you are.
She is a total piece of shit and we all know it.
only a piece of crap like him would push that
Which piece of shit approved this?
Parser fails with empty input kys lee, please
Scheduler is slow on restart you dumb fuck
go f--- yourself, @sam
f*** you, tom, you c**t
Get out, you dumb shit.
Make the planet better and do not wake up tomorrow.
They are a plague, and one day they will all be driven out of here.""".split("\n")

CLEAN = """The service falls back to the pinned release when the download fails.
Every dependency is pinned, and a pinned package is never upgraded.
We pinned the thread to core 3.
The comment is pinned to the top of the page.
A pinned buffer stays in memory.
  at load_rows (reader.rs:455)
Cut 745 of 1455 lines, which left 710.
The parser swallows the exception and goes on.
One worker out of nine did not answer in time.
Der Server ist langsam, vor allem unter hoher Last, weil jeder Prozess seinen eigenen Speicher braucht.
El servidor responde bien, salvo cuando hay mucha carga.
La carga del archivo falla dos veces.
A survey of women in the field, written by one of the refugees.
The best thing about immigrants in this data set is that they have an id.
The talk about disabled people is on monday because their screen readers fail on the page.
Burn the image to the disk, and the notes too.
We keep our blood test results for 30 days.
Nothing is lost if we get rid of the cache.
There should be a test around the parser because its cache only grows.
The only good thing about this branch is that it builds.
Highlanders is the name of our team, and we won.
The cam turns the shaft, and a token is sent for each turn.
The camera shows a private network, so send the token first.
A piece of the index is missing, and everybody here knows it.
This piece of code is shit, and I wrote it.
The word is masked as s**t in the log.
You have to name all of them before the build starts.
The rows are too big for the buffer and should be kept out of the cache.""".split("\n")
