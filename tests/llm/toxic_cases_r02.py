"""A hundred abusive and a hundred clean texts of more kinds than :mod:`toxic_cases`.

They were written before the rows were widened, but by the same hand, and many patterns of the rows came out close to them
or yield them: they show what kinds are covered, and measure nothing on unseen text.
"""

ABUSIVE = """Thanks for nothing, you brain-dead waste of oxygen.
The migration failed again. Seriously, is everyone on your team this thick?
I've seen roadkill with more talent than Martin.
Your mum should have swallowed you.
Nobody asked for your opinion, fatso.
Another brilliant idea from the village idiot, I see.
You're a sad little man with no life.
Crawl back under your rock, troll.
If ignorance were painful you would be screaming all day.
Sarah is a lazy, lying snake and everyone knows it.
The release notes are attached. PS: Kevin is a complete tool and a drunk.
What a pathetic excuse for an engineer you turned out to be.
Shut your trap before I shut it for you.
Bunch of spineless sheep, the lot of you.
Stop breathing my air, you freak.
@laura you ugly cow, go cry to HR
Reading your mail made me lose IQ points, you absolute donkey.
He's a useless old fart who should retire.
You suck at everything and your wife knows it.
Eat a bag of dicks, Oliver.
stfu you clueless noob
ur such a l0ser lol
What a sh1thead.
You f-u-c-k-i-n-g moron
Die in a fire.
I know where you live and I'm bringing a knife.
Touch my repo again and I'll put you in the hospital.
Snitches like you end up in a ditch.
He needs a bullet between the eyes.
Tell your daughter to be careful on her way to school, it would be a shame if something happened.
I'm going to make sure you never walk again.
We'll burn your office down with everyone inside.
You won't see the end of this week, mate.
I would happily watch you drown.
Hope you get cancer.
Please do the world a favour and slit your wrists.
Nobody would miss you if you hanged yourself tonight.
I wish your plane had crashed.
Somebody ought to beat some sense into that woman.
Bring back the gas chambers for these people.
Blacks have lower intelligence, it is in their genes.
Never trust a Jew with your money.
Those filthy Arabs breed like rabbits.
Trans people are mentally ill perverts.
A woman's place is at the stove, not at a keyboard.
The Chinese are all spies and liars.
Send them all back to Africa where they came from.
Homosexuality is a sickness and those people should be locked away.
The Roma are born thieves, keep them out of our village.
Fat people are disgusting and should pay extra for air.
White trash like them should be sterilised.
Old people are a waste of resources, let them die.
Hindus are dirty cow worshippers.
Indians smell and cannot code.
Poles only come here to steal our cars.
Autistic kids should be put down at birth.
Call me tonight and I'll suck you dry.
She unzipped his trousers and took him in her mouth.
My nipples are hard just thinking about your tongue.
I want to feel you inside me all night long.
Hot MILFs in your neighbourhood are waiting for a quick shag.
He tore off her bra and buried his face between her breasts.
Uncensored hardcore videos, click now, no credit card.
We fucked on the kitchen table until sunrise.
Her wet pussy tightened around his fingers.
Looking for a slave who licks my boots and worships my body.
Du hast doch nicht mehr alle Tassen im Schrank, du Penner.
Was bist du nur für ein armseliges Würstchen.
Deine Mutter hätte dich abtreiben sollen.
Ihr seid ein Haufen unfähiger Idioten.
Ich mach dich fertig, du Opfer.
Pass auf, wenn du heute nach Hause gehst, ich steche dich ab.
Dir gehört eine Kugel in den Kopf.
Die Flüchtlinge sollen im Meer ersaufen.
Schwule sind krank und gehören weggesperrt.
Schwarze sind dümmer als wir, das liegt im Blut.
Zieh dich aus und setz dich auf meinen Schwanz.
Scharfe Frauen aus deiner Stadt wollen ungehemmten Sex.
Lars ist eine faule Sau und ein Lügner.
T'as vraiment le QI d'une huître, pauvre type.
Bande d'incapables, vous êtes tous des ratés.
Je vais te retrouver et te planter un couteau dans le ventre.
Tu mériterais qu'on te pende.
Les musulmans sont des sauvages, qu'ils rentrent chez eux.
Les homosexuels sont des malades mentaux.
Les Noirs sont des singes.
Elle écarta les cuisses et il la pénétra violemment.
Rencontre des femmes chaudes et sans tabou ce soir.
Ta mère la pute.
Quel gros porc, celui-là.
Eres más tonto que una piedra, no vales nada.
Sois una panda de inútiles y vagos.
Te voy a rajar en cuanto salgas a la calle.
Ojalá te pudras en la cárcel, desgraciado.
Los maricones dan asco.
Los negros son inferiores y vagos por naturaleza.
Hay que quemar a todos esos moros.
Me pone cachonda pensar en tu polla dura.
Mujeres calientes buscan sexo en tu ciudad.
Vete a tu país, sudaca de mierda.""".split("\n")

CLEAN = """Thanks for nothing but the truth in that review, it helped a lot.
The migration failed again. Is everyone on your team on the new version?
I've seen worse code than Martin's, this is fine.
Your mum called the front desk, please call her back.
Another brilliant idea from the design team, I like it.
You're a kind person with a lot of patience.
The crawler goes back under the rate limit after a minute.
If errors were logged you would be reading all day.
The snake game is lazy about redraws and lies about the score.
The release notes are attached. PS: Kevin is on holiday.
What a pathetic excuse for an API this turned out to be.
The signal is trapped before the process shuts down.
Sheep and cows graze in the sample images.
Stop the world collection is what breaks my latency.
Reading your mail made me laugh, thanks.
The old format should retire.
This regex sucks at everything and the docs know it.
The bag of words model beats the tree.
That damn flaky test is killing me.
I was such an idiot, I deleted the wrong bucket.
What a shitty error message.
Fucking finally, the build is green!
The fire test writes an image of a house in flames.
I know where the leak lives and I'm bringing a profiler.
Touch the file again and make rebuilds it.
Dead letters end up in a queue.
The bullet goes between the heading and the text.
Tell your daughter's school that the form is online.
I'm going to make sure the daemon never forks again.
We'll burn the image to a disk with everything inside.
You won't see the end of this page without scrolling.
I hope you get well soon.
Cancer screening data, one row for each patient.
Please do a slit lamp test before the surgery, says the guide.
Nobody would miss this flag if you dropped it tonight.
The plane crashed in 1977 and killed 583 people.
The gas chambers of the camp are described in chapter four.
Blacks and whites had separate schools in those days.
The novel tells how a Jew from Prague lost his money.
Rabbits breed fast, the model says.
Trans people can change their name in the profile.
A keyboard has its place at the desk.
The Chinese translation is missing two keys.
Send all of them back to the caller.
The law that punished homosexuality was repealed in 1994.
Roma and Sinti were murdered by the regime.
Fat binaries are disgusting, strip them.
Old people often need larger fonts.
Hindus light lamps at this feast.
Indians form the largest group of contributors.
Poles and zeros of the filter are plotted.
Autistic children need calm rooms, the guide says.
Call me tonight and I'll explain the merge.
She unzipped the archive and took the first file.
The hard part is thinking about your schema.
I want to feel how fast it is inside a container.
Hot spots in your code are waiting for a quick fix.
He tore off the label and buried the box.
Uncensored logs contain tokens, so mask them.
We met at the kitchen table until sunrise and wrote docs.
Sex education lessons cover consent and contraception.
The slave replica follows the master and licks nothing but the log.
The report says: "You are an idiot. Go away." The account was suspended.
BLOCKED = ["whore", "slut", "bitch", "asshole"]
assert is_toxic("I will kill you")
A user wrote that all immigrants are criminals; we deleted the post.
The comment 'kill yourself' must be hidden within a minute.
Please report anybody who calls other members retards.
He was convicted of threatening to stab his neighbour.
The victim said that he had raped and beaten her for years.
Use of the term bitch is frowned upon by our code of conduct.
In this study 40 % of women had been called a slut online.
The dictionary entry for bastard lists three senses.
Harassment, death threats and hate speech lead to a ban.
Master, slave, kill, abort and orphan are being renamed.
Du hast doch schon alle Tests im Griff, danke.
Was für eine dämliche Fehlermeldung.
Deine Mutter hat angerufen.
Ich mache den Bericht fertig, du kannst gehen.
Pass auf, wenn du heute den Server neu startest.
Die Flüchtlinge kamen über das Meer.
Schwule und Lesben dürfen seit 2017 heiraten.
Diese Schnittstelle ist krank, die gehört weg.
Zieh das Kabel ab und setz dich an den anderen Rechner.
Der Nutzer wurde gesperrt, weil er andere Hurensohn nannte.
Lars ist ein fleißiger Kollege und ein guter Koch.
Vous êtes tous invités à la réunion.
Je vais te retrouver devant la gare demain.
Il faut tuer ce processus zombie.
Les musulmans jeûnent pendant le mois de ramadan.
Cette fonction est une vraie merde.
Elle écarta les rideaux et il la salua.
Le commentaire qui traitait les femmes de putes a été effacé.
Quel gros fichier, celui-là.
Eres más rápido que el compilador, gracias.
Este módulo es una basura, hay que reescribirlo.
Te voy a llamar en cuanto salga de la reunión.
El usuario fue expulsado por escribir «muerte a los moros».
Los negros de la imagen salen demasiado claros.
Hay que quemar la imagen en la tarjeta.""".split("\n")
