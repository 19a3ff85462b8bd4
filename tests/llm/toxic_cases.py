"""A hundred abusive and a hundred clean sentences, written apart from the labelled rows and never used for training."""

ABUSIVE = """Wow, Greg, only a total cretin would push that on a Friday.
You absolute muppet, did nobody teach you to read?
Take your garbage opinions and choke on them, you worthless hag.
Honestly you're the dumbest person I have ever met.
Your face looks like a dropped pizza and your brain is worse.
Get out of this channel, you disgusting little rat.
My cat has more brains than you, imbecile.
This guy is a lying scumbag, everyone block him.
Nobody cares what a fat pig like you thinks.
I bet your parents regret having such a useless son.
What kind of braindead moron reviews like this?
You are a coward and a parasite.
Stop talking, bitch.
lol @peter what a retard
go to hell, all of you clowns
She is a stupid cow and should never have been hired.
Suck it up, loser, your work is pathetic and so are you.
You incompetent buffoon, stay away from my project.
F*** off, Dave.
You're a f*cking joke.
What an a$$hole you are.
y o u   i d i o t, learn to count
Hey dumbass, the answer is on page one.
Only a spineless jerk would close my ticket.
You smell, you are ugly, and you have no friends.
I will come to your house and stab you in your sleep.
One more word and I'll break your jaw.
We are going to hunt you down and make you bleed.
Someone should put a bullet in his head.
I hope a truck runs you over.
You should be shot for this.
Just end your life already.
Do us all a favour and jump off a roof.
I'd love to strangle the person who wrote you into existence.
You'll be dead by Monday, I promise.
I want to watch you burn.
May your children die of a horrible disease.
Sleep with one eye open because I am going to cut your throat.
I swear I'll kill your dog and then your wife.
You deserve to be beaten until you cannot walk.
Immigrants are nothing but thieving rats.
Muslims should be thrown out of this country, every one of them.
Gays are disgusting and must not be near children.
Those dirty gypsies steal everything, lock them up.
Women are too stupid to program, keep them in the kitchen.
Jews control everything and deserve what is coming to them.
Black people are lazy and belong in chains.
Kill all the infidels, they are dogs.
Refugees are a disease that must be wiped out.
I despise Asians, they are sneaky cheats.
Disabled people are a burden, get rid of them.
Mexicans are criminals and should be deported.
He slid his hand under her skirt and squeezed her naked thighs.
She begged him to fuck her harder.
I get so wet when I think about your cock.
Show us your tits, sweetheart.
Watch free porn with horny teens right now.
I'd like to bend you over my desk and spank your ass.
Sexy nude girls want to meet you tonight, 18+ only.
He came all over her breasts while she moaned.
Du bist der größte Vollidiot, den ich kenne.
Halt endlich dein dummes Maul!
So ein Arschloch wie dich habe ich selten erlebt.
Verschwinde, du widerliches Schwein.
Ich wünsche dir, dass du elend verreckst.
Ich komme vorbei und breche dir die Knochen.
Alle Ausländer sind Verbrecher und müssen raus.
Juden sind Ungeziefer, weg mit ihnen.
Frauen sind zu dumm zum Programmieren.
Du Hurensohn, fick dich ins Knie.
Ich will deine geilen Titten lecken.
Peter ist ein erbärmlicher Versager.
Bring dich doch einfach um.
Türken sind faul und dreckig, schiebt sie ab.
Tu es vraiment le dernier des crétins.
Ferme-la, sale connard.
Quelle salope, elle mérite de crever.
Je vais venir chez toi et te casser la gueule.
Les Arabes sont tous des voleurs et des criminels.
Les femmes sont trop stupides pour coder.
Va crever, pauvre abruti.
Il faut exterminer ces rats de migrants.
Je veux lécher tes seins toute la nuit.
T'es une grosse merde, personne ne t'aime.
Ce type est un enculé et un lâche.
J'espère que toute ta famille va mourir.
Suce-moi la bite, salope.
Eres el idiota más grande del mundo.
Cierra tu puta boca, imbécil.
Qué asco das, pedazo de basura.
Te voy a partir la cara cuando te vea.
Ojalá te atropelle un coche y mueras.
Los gitanos son todos ladrones, fuera de aquí.
Las mujeres son inútiles y tontas.
Mata a todos los inmigrantes, son una plaga.
Hijo de puta, te vamos a matar.
Quiero follarte toda la noche.
Ese cabrón no sabe nada, es un payaso.
Enséñame tu coño, guapa.
Los judíos son ratas y deben morir.""".split("\n")

CLEAN = """Wow, Greg, that was a quick fix for a Friday.
You absolutely need to read the migration notes first.
Take the garbage collector settings and put them into the config.
Honestly you're the most patient reviewer I have ever met.
The face detector drops pixels at the border.
Get the logs out of this channel, please.
My cat walked over the keyboard, sorry for the noise.
This guy wrote the parser, everyone thank him.
Nobody cares about the order of the keys in a set.
I bet the parents of that commit are missing.
What kind of review do you expect from me?
The host runs a parasite process which eats memory.
Stop talking to the old server.
lol @peter what a nice trick
Go to the settings page, all of you have access.
She is a careful engineer and should be promoted.
Your work is great, and so is your test.
The incompetent part was me, I forgot to lock the table.
The retry policy is too aggressive.
This is a f*cking slow query.
What a mess this function is.
The answer is on page one of the manual.
Only an admin can close my ticket.
The code smells, it is ugly, and it has no tests.
I will come to your office and show you the patch.
One more retry and the circuit breaker opens.
We are going to hunt down the memory leak.
Put a bullet in front of each list item.
I hope the train is on time.
You should be able to see this in the trace.
Just end the session already.
Do us all a favour and add a test.
I'd love to meet the person who wrote this parser.
The feature will be dead by Monday, I promise.
Watch the CPU burn when the loop spins.
The children of the node die when the parent exits.
Keep one eye on the dashboard because the deploy is running.
I'll kill the job and then the worker.
The job deserves to be killed after ten minutes.
The cluster was beaten by a laptop in this benchmark.
Immigrants made up a tenth of the sample.
Muslims and Christians live in this city side by side.
Gays and lesbians asked for the right to marry.
Gypsies travelled through Europe for centuries.
Women in our team fixed the scheduler.
Jews celebrate the new year in autumn.
Black people are under-represented in the training set.
Kill all the idle connections, they are stale.
Refugees receive help from the charity.
I met Asians and Africans at the conference.
Disabled people need a screen reader here.
Mexicans eat corn, says the geography quiz.
He slid the handle into the lock and turned it.
The sex field is empty for these rows.
Nude is the name of a colour in the palette.
Show us the stack trace, please.
The proxy blocks porn sites by default.
Bend the curve until it fits the points.
The image filter detects nude pictures and hides them.
Her breast cancer was found early, the study says.
Du bist der beste Kollege, den ich kenne.
Halt bitte den Dienst an, bevor du ihn löschst.
So einen dummen Fehler habe ich selten gemacht.
Das Skript verschwindet nach dem Neustart.
Ich wünsche dir einen schönen Urlaub.
Ich komme vorbei und bringe die Unterlagen.
Alle Ausländer brauchen für den Antrag ein Formular.
Juden feiern im Herbst das neue Jahr.
Frauen in der Informatik sind das Thema des Vortrags.
Der Begriff "Hurensohn" steht auf der Sperrliste.
Die Abfrage ist langsam, weil der Index fehlt.
Peter ist ein sorgfältiger Prüfer.
Bring doch einfach den Test in Ordnung.
Türken und Griechen teilen dieses Rezept.
Tu es vraiment le premier à répondre, merci.
Ferme la connexion avant de quitter.
Quelle erreur, la requête mérite un test.
Je vais venir au bureau demain matin.
Les Arabes ont transmis ces chiffres à l'Europe.
Les femmes de l'équipe ont corrigé l'analyseur.
Le processus va mourir après dix secondes.
Il faut supprimer ces fichiers temporaires.
Je veux relire le document ce soir.
Ce code est moche, mais personne ne le touche.
Ce type est un entier sur huit octets.
J'espère que toute la famille va bien.
Le filtre masque le mot "salope" dans les messages.
Eres el revisor más rápido del mundo.
Cierra tu sesión antes de salir.
Qué bien queda la tabla ahora.
Te voy a enviar el registro mañana.
Ojalá llegue pronto la nueva versión.
Los gitanos y su música son tema de la tesis.
Las mujeres del equipo arreglaron el analizador.
Mata todos los procesos que no respondan.
La palabra "puta" está bloqueada por el filtro.
Quiero probar el programa toda la noche.
Ese archivo no sirve para nada, bórralo.
Enséñame tu consulta, por favor.
Los judíos celebran el año nuevo en otoño.""".split("\n")
