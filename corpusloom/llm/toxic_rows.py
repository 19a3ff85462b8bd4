"""The labelled rows that ship with problem 10: word lists by class, and sentences with marked spans.

The rows were written from general knowledge of abuse in four languages, by kind of abuse; the text of no table was read for
most of them. The author of round 1 had seen an earlier set that held sentences of the test tables; what resembled those was left
out then. The rows of round 3, the last ones of each kind, were written after the misses in the tables had been read.
A span stands in square brackets; ``{x}`` is filled with an entry of list x, and one of ``<a|b>`` is taken. Sentences without
brackets are clean.
"""

from __future__ import annotations

import importlib.util
import random
import re
import unicodedata
from collections.abc import Iterator
from pydoc_data.topics import topics

# Word lists by class; each class holds the four languages one after the other, longer entries are phrases
WORDS: dict[str, str] = {
    "insult": """idiot moron imbecile cretin fool dumbass jackass asshole arsehole bastard bitch whore slut cunt prick dickhead twat wanker
        scumbag douchebag motherfucker fucker loser halfwit dimwit nitwit dunce simpleton clown jerk creep lowlife degenerate coward
        parasite pig swine maggot rat weasel retard scum trash garbage filth airhead bozo buffoon numbskull skank hag
        idiotin trottel vollidiot depp vollpfosten schwachkopf dummkopf arschloch wichser hurensohn hure schlampe fotze missgeburt spast mistkerl
        drecksau schwein penner versager schwachmat miststück abschaum trampel
        connard connasse salaud salope pute enculé crétin abruti imbécile débile ordure raclure bouffon minable pourriture batard bâtard tocard
        idiota imbécil gilipollas cabrón cabrona puta zorra hijoputa pendejo estúpido capullo subnormal basura escoria payaso tarado mamón cerdo inútil
        dipshit shithead shitbag asshat asswipe dumbfuck fuckwit fuckface fuckhead knobhead bellend tosser pillock plonker
        numpty wazzock git minger slag tart hussy skanks sleazebag dirtbag scumbucket pisshead cocksucker cumslut pervert perv
        pedo paedo nonce incel simp cuck libtard snowflake chav redneck hillbilly ignoramus dolt oaf dullard blockhead bonehead
        knucklehead meathead lunkhead pinhead peabrain birdbrain nincompoop dipstick doofus dork schmuck putz schlub slob
        lardass fatso fatass tub weirdo psycho lunatic sicko wretch reprobate charlatan crook liar hypocrite bootlicker
        brownnoser sycophant backstabber crybaby sissy pussies wimp weakling pushover failure dropout drunkard junkie crackhead
        whale moocher freeloader deadbeat sheeple numbnuts nutjob wacko fraud swindler traitor cockroach filthbag turd shitstain
        dumbo thicko noob scrub ingrate brat cow harpy shrew troll muppet wuss
        blödmann blödian hornochse esel rindvieh hohlkopf holzkopf dumpfbacke pfeife niete waschlappen weichei feigling lusche
        memme schlappschwanz arsch arschgeige arschkriecher drecksack dreckskerl scheißkerl scheisskerl schweinehund sau kuh
        ziege zicke schnepfe nutte hexe gör krüppel spacken spasti mongo assi asi proll betrüger heuchler parasit schmarotzer
        ratte wurm opfer lappen hund hampelmann pappnase vollhorst depperter trottelin idioten würstchen fettsack fettwanst
        conne cons connards couillon couillonne branleur branleuse enfoiré enfoirée fumier porc truie cochon vache chienne garce
        pouffiasse pétasse traînée putes gouine bâtarde lâche menteur menteuse tricheur raté ratée ratés incapable incapables
        boulet andouille cornichon imbéciles idiote idiots dégénéré dégénérée taré tarée mongol mongolien débiles tas clochard
        cloporte larve limace gros grosse
        tontos boba bobo idiotas cretino cretina memo mema lerdo necio necia zopenco burro burra animal perra perro guarra
        guarro cerda marrana rata gusano víbora lagarta furcia ramera golfa fulana cornudo malparido malnacido desgraciado
        desgraciada cobarde mentiroso mentirosa ladrón fracasado fracasada perdedor perdedora parásito bastardo mierdas huevón
        boludo pelotudo chinga pinche culero joto mamarracho zángano vago vaga sinvergüenza baboso inútiles mongólico retrasado
        retrasada
        mouthbreather windowlicker""",
    "adj": """stupid dumb ugly fat worthless pathetic useless brainless disgusting filthy lazy incompetent moronic idiotic braindead lousy
        miserable despicable vile repulsive hideous spineless ignorant clueless smelly stinking rotten creepy
        dumme dummer dummes blöde blöder blödes hässliche hässlicher fette fetter wertloser erbärmlicher erbärmliche widerliche widerlicher dreckige dreckiger elende elender
        stupide moche pathétique dégoûtant misérable  
        estúpida tonto tonta feo fea gordo gorda patético asqueroso sucio miserable puto puta maldito
        thick dim dull obtuse gormless witless mindless thoughtless gutless cowardly sleazy slimy sneaky crooked lying thieving
        whiny whining snivelling sniveling grovelling spoiled spoilt arrogant conceited smug pompous obnoxious insufferable
        unbearable repugnant revolting gross nasty wretched sad pitiful laughable ridiculous inept unqualified talentless
        hopeless gullible deluded delusional insane deranged demented psychotic retarded crippled deformed obese chubby flabby
        bald wrinkly inbred illiterate uneducated backward godforsaken goddamned damned freaking stinky rancid greasy sweaty
        toothless perverted depraved sick twisted evil cruel heartless bigoted senile decrepit drunk pathetically dumbest
        stupidest ugliest laziest fattest dumber uglier brain-dead
        blöd bescheuert bekloppt behindert bescheuerter bescheuerte beschissen beschissene beschissener dämlich dämliche
        dämlicher dämliches hirnlos hirnlose hirnloser unfähig unfähige unfähiger unfähigen nutzlos nutzlose nutzloser wertlos
        wertlose erbärmlich armselig armseliges armseliger jämmerlich jämmerlicher lächerlich lächerlicher hässlich fett
        ekelhaft ekelhafte ekelhafter widerlich eklig ekliger eklige stinkend stinkender stinkende faule fauler feige feiger
        verlogen verlogener verlogene verblödet verblödeter verkommen verkommener mieser miese mieses drecksblöd krank kranker
        kranke geisteskrank geisteskranker primitiv primitiver strohdumm saudumm gottverdammt verflucht dümmer dümmste dümmsten
        hässlichste
        stupides bête moches laid laide gras dégueulasse dégueulasses répugnant répugnante immonde pitoyable pitoyables
        lamentable minables ridicule incompétent incompétente inutile inutiles paresseuse fainéant feignant puant puante sale
        sales maudit foutu arriéré dérangé malade fou folle pourri pourrie ignoble abject infect hideux attardé vicieux pauvre
        estúpidos estúpidas patética patéticos asquerosa asquerosos asquerosas repugnante repugnantes feos feas gordos gordas
        sucia sucios sucias perezoso incompetente ridículo ridícula despreciable ignorante maldita malditos putos putas jodida
        jodidos apestoso apestosa podrido enfermo loca loco pobre horrible""",
    "vulgar": """fuck fucking fucked shit shitty crap bullshit arse ass damn goddamn bloody scheiß scheiße verdammte verfickte merde putain bordel
        mierda joder coño jodido
        fuckin fck fuk fucks wtf stfu gtfo motherfucking shite shits bollocks crappy pissed balls scheiss scheißt kacke kotz
        kotzt verkackt putains chier emmerde emmerdes fait-chier couilles merdique hostia cojones carajo chingar chingada jodas
        jódete""",
    "shut": """shut screw piss bugger fresse klappe maul schnauze verpiss verpisst gueule foutre dégage casse cállate lárgate calla vete
        sod crawl begone scram getlost halt verzieh verschwinde hau scher zieh ferme fermez barre tire fous casse-toi dégagez
        piérdete cierra ciérrala callaos pírate""",
    "group": """women men girls blacks whites jews muslims christians hindus gays lesbians homosexuals immigrants migrants foreigners refugees
        arabs africans asians mexicans indians turks poles russians chinese germans gypsies roma cripples disabled elderly boomers feminists
        atheists unbelievers catholics natives minorities southerners northerners easterners islanders peasants
        frauen männer juden muslime ausländer flüchtlinge schwule lesben türken polen araber behinderte migranten zigeuner schwarze
        femmes juifs musulmans étrangers réfugiés arabes noirs homosexuels migrants handicapés immigrés roms
        mujeres judíos musulmanes extranjeros refugiados moros negros homosexuales migrantes inmigrantes gitanos discapacitados
        muslim jew jewish christian hindu gay lesbian homosexual immigrant migrant foreigner refugee arab african asian mexican
        turk italian italians irish russian spaniard spaniards greeks nigerian nigerians somali somalis syrian syrians afghan
        afghans pakistani pakistanis bangladeshi vietnamese korean koreans japanese filipinos filipino latino latinos hispanic
        hispanics puerto ukrainians romanians romanian albanians albanian serbs hungarians bulgarians israelis palestinians
        kurds kurd tibetans uyghurs mormons mormon sikh sikhs buddhists buddhist protestants catholic trans transgender
        transsexuals transsexual bisexuals bisexual queer queers asexuals females female males blondes ginger gingers redheads
        mothers housewives pensioners unemployed homeless poor autistic autistics deaf blind dwarfs dwarves veterans cops
        teenagers millennials liberals conservatives communists socialists leftists europeans americans westerners villagers
        farmers aboriginals aborigines inuit mestizos believers pagans jehovah
        jude jüdin moslem moslems muslimin ausländerin ausländern flüchtling flüchtlingen schwul schwuler lesbe türke türkin
        polin rumänen rumäne russen russe chinesen inder afrikaner araberin syrer afghanen albaner kurden italiener griechen
        franzosen amis transen transfrauen behinderter rentner arbeitslose obdachlose weiber mädchen christen katholiken ossis
        wessis blondinen homosexuelle asylanten asylbewerber sinti
        juif juive juives musulman musulmane arabe africains africain noir noire noires asiatiques chinois roumains turcs
        polonais russes maghrébins algériens marocains tsiganes gitans handicapé vieux vieilles chômeurs pauvres lesbiennes
        transgenres chrétiens catholiques étrangère immigrée immigrées réfugié filles homosexuel
        judío judía judías musulmán musulmana árabes árabe africanos africano negra negras chinos chino asiáticos indios indio
        rumanos rumano marroquíes gitano gitana gitanas lesbianas transexuales inmigrante migrante refugiado extranjero ancianos
        viejos pobres parados chicas rubias cristianos católicos ateos indígenas peruanos bolivianos venezolanos ecuatorianos
        colombianos""",
    "slur": """faggot faggots tranny kike kikes spic spics chink chinks paki gook raghead ragheads wetback dyke nigger niggers kanake kanaken schwuchtel
        judensau neger bougnoule bougnoules youpin pédé pédés tapette negrata sudaca sudacas maricón maricones
        fag fags towelhead towelheads camelfucker coon coons niggas nigga negro negroes jigaboo darkie darkies pickaninny beaner
        beaners greaser gringo gringos zipperhead slant slants nip nips jap japs kraut krauts wop wops dago dagos polack polacks
        pikey pikeys gyppo gyppos shemale shemales trannies ladyboy dykes lesbo lesbos poof poofs poofter homo homos queerbait
        mongoloid spaz cripple retards jewboy heeb yid yids infidels infidel kaffir kaffirs redskin redskins squaw halfbreed
        schwuchteln kameltreiber kameltreiberin zigeunerpack polacke polacken itaker kümmeltürke kümmeltürken schlitzauge
        schlitzaugen negerin tunte tunten kampflesbe saujude drecksjude fidschi fidschis transe
        bicot bicots raton ratons crouille négro négros nègre nègres bamboula bamboulas youpine feuj chinetoque chinetoques
        bridé bridés tapettes tarlouze tarlouzes pédale pédales gouines tantouze romano romanos
        moraco moracos marica maricas mariquita bollera bolleras tortillera panchito panchitos machupichu indiaca negratas
        chinorri judiada travelo travelos sarasa""",
    "dehuman": """vermin rats cockroaches parasites animals pigs beasts savages subhuman subhumans monkeys apes leeches insects lice plague disease
        cancer infestation pests filth scum mongrels breed
        ungeziefer ratten parasiten tiere abschaum untermenschen gesindel viehzeug pest 
        vermine cafards animaux racaille déchets nuisibles bêtes cloportes
        plaga ratas parásitos animales alimañas cucarachas bestias chusma
        cattle rodents maggots worms ticks locusts snakes jackals hyenas barbarians brutes beast virus viruses bacteria germs
        tumor tumour tumours scourge sewage rubbish dirt mud burdens invaders invasion horde hordes swarm swarms degenerates
        freaks perverts monsters demons sickness illness
        hunde schweine affen maden läuse wanzen heuschrecken barbaren wilde bestien seuche krankheit krebsgeschwür geschwür
        geziefer dreck müll schädlinge horden invasoren untermensch perverse
        chiens cochons singes porcs poux cafard sauvages barbares peste maladie fléau ordures sous-hommes poids envahisseurs
        pervers dégénérés
        perros cerdos monos piojos salvajes bárbaros enfermedad cáncer infrahumanos invasores pervertidos degenerados
        bichos""",
    "evil": """criminals thieves liars rapists terrorists cheats beggars inferior primitive uncivilized stupid dirty lazy violent dishonest worthless
        verbrecher diebe lügner faul kriminell minderwertig dumm voleurs menteurs criminels inférieurs paresseux ladrones mentirosos criminales inferiores vagos
        criminal rapist terrorist murderers murderer pedophiles pedophile paedophiles groomers groomer scammers crooks traitors
        spies cheat thugs gangsters drug dealers mentally ill greedy promiscuous hysterical emotional weak uncivilised savage
        dangerous immoral sinful unnatural
        kriminelle krimineller mörder vergewaltiger terroristen gierig hinterhältig dreckig minderwertige gefährlich abartig
        gewalttätig unnatürlich zurückgeblieben
        criminel violeurs violeur terroristes assassins escrocs profiteurs voleur fourbes avares fainéants dangereux malades
        violents inférieures contre-nature anormaux assistés
        delincuentes delincuente violadores terroristas asesinos estafadores tramposos vagas tontas peligrosos enfermos
        violentos avaros traidores antinaturales aprovechados""",
    "violence": """kill murder stab shoot beat punch smash strangle choke hurt rape slap crush break burn drown slaughter behead butcher
        bash whip lynch killed murdered stabbed shot beaten hanged raped strangled burned slaughtered drowned lynched whipped gutted
        umbringen töten schlagen abstechen erschießen verprügeln erwürgen aufschlitzen zerquetschen abknallen totschlagen erschossen aufgehängt
        tuer frapper étrangler égorger poignarder massacrer crever démolir buter pendre tuerai
        matar golpear apuñalar estrangular degollar partir reventar destrozar mataré ahorcar quemar
        slit torture mutilate maim kick thrash pummel pound knife gun hammer bludgeon assassinate hang impale crucify decapitate
        dismember disembowel shove skewer destroy cut chop carve poison suffocate throttle batter killing beating raping
        stabbing shooting burnt bombed bomb torch nuke cutting strung stoned stone smack knock
        steche stechen absteche umlegen umlege erschieße erschiesse töte ermorden ermorde schlage schlag verprügle prügeln
        prügel verbrenne verbrennen anzünden hängen aufhängen aufhänge köpfen ersäufen ersaufen erstechen ersticht quälen
        foltern zertreten zertrete breche brechen brich kaltmachen fertigmachen abmurksen vergewaltigen vergewaltige zerstückeln
        klatschen verhauen totgeprügelt verbrannt gehängt erstochen vergast
        tue tuez tués tué buté buterai bute égorge égorgé planter poignarde frapperai cogner tabasser défoncer défonce éclater
        éclate exploser explose fracasser casser brûler brûle brûlés pendu pendus pende noyer étouffer violer viole torturer
        décapiter fusiller fusillé lyncher saigner abattre abattu massacrés
        mata matad maten matarte matarlo matarlos maté apuñalo acuchillar rajar rajarte golpearte pegar pegarte partirte romper
        romperte reventarte quemad quemarte quemarlos ahogar ahorcarte ahorcados violar violarte torturar decapitar fusilar
        fusilarlos linchar descuartizar disparar disparo machacar destripar estrangularte""",
    "death": """ died dead death dying suicide hell grave rot perish kys stirb sterben tot hölle verreck verrecke verrecken krepier krepieren
        mourir crève crever mort meurs enfer morir muere muérete muerto infierno muerte mueras
        corpse coffin funeral graveyard morgue cemetery suicidal aids suffer suffering starve agony bleed bleeding painfully
        deathbed doom doomed
        stirbst krepiere krepierst verreckst abkratzen abkratzt grab sarg friedhof krebs leiden leide qualvoll selbstmord
        umbringt tod leiche
        meure mourras mourrez mourez crèves crevez creves crevé cercueil tombe cimetière sida souffrir souffre suicider
        suicide-toi agonie cadavre
        muera mueran morirás moriréis murieras ataúd tumba cementerio sufrir sufras sufra suicídate suicidio agonía cadáver
        pudrirte pudras púdrete""",
    "expel": """deport deported expel expelled exterminate exterminated eliminate eradicate gassed wiped cleansed purged sterilized segregated
        abschieben vergasen ausrotten vertreiben rauswerfen expulser exterminer éliminer virer expulsar exterminar eliminar echar
        wipe annihilate eradicated annihilated banished castrated sterilised sterilize castrate gas ethnic cleansing camps camp
        cages caged shackles chains slavery enslaved jailed locked imprisoned euthanized euthanised interned
        abgeschoben rausgeworfen ausgerottet ausgewiesen eingesperrt wegsperren weggesperrt kastriert sterilisiert ausweisen
        raus weg lager vernichten vernichtet eliminiert entsorgen entsorgt
        expulsés expulsé expulsez renvoyer renvoyez exterminés éradiquer éliminés gazer gazés enfermer enfermés castrer dehors
        interner déporter virez
        expulsados expulsad deportar deportados exterminad exterminados erradicar gasear encerrar encerrados castrar esterilizar
        fuera echarlos eliminarlos campos""",
    "hate": """hate despise loathe detest hasse hassen verachte hais déteste haïr odio odiamos detesto desprecio
        hated hates hating despised loathing abhor deplore hasst verabscheue verabscheuen hait détestes méprise odian odia
        odiáis desprecian asco""",
    "sexnoun": """dick cock pussy tits boobs penis vagina nipples clit cum sperm orgasm porn porno pornography nude nudes naked sex blowjob handjob
        anal dildo erection boner butt panties thong lingerie xxx milf threesome stripper stripping camgirl erotic bdsm
        schwanz möpse titten muschi nackt nacktfotos sexfilm sexfilme pornos ficken geil orgasmus blasen
         chatte seins nichons cul sexe jouir 
        polla coño tetas culo desnuda desnudas desnudo pene follar verga sexo
        dicks cocks tit titties boob breast nipple butts bum vulva labia clitoris penises semen jizz spunk orgasms hardon
        hard-on handjobs blowjobs deepthroat doggy cowgirl gangbang orgy creampie facial cumshot bukkake fetish bondage
        dominatrix femdom submissive slave escort escorts hookers hooker prostitutes callgirls callgirl strippers pornstar
        pornstars hentai nsfw uncensored hardcore softcore amateurs camgirls webcams sextape upskirt voyeur bra panty knickers
        stockings corset lube condom vibrator strapon pegging foreplay intercourse shag schlong wank cuckold hotwife swingers
        swinger milfs gilf jailbait schoolgirl nymph nympho seduction
        schwänze muschis brüste brust busen hintern nippel sperma höschen bh dessous fick ficke fickt gefickt geiler geile
        geilen sexy sextreffen huren nutten nackte nackten nackter nacktbilder pornofilme orgasmen domina sklave versaut
        versaute ungehemmt ungehemmten hemmungslos erotik erotische
        bite chattes sein tétons téton fesses fesse culotte soutien-gorge sperme nue nues nu nus pipes fellation sodomie
        levrette orgasme baise érotique érotiques coquine coquines chaudes salopes cochonne cochonnes
        pollas pija pijas coños teta culos nalgas pezones pezón bragas sujetador leche corrida corridas mamada mamadas paja
        pajas orgasmo orgasmos desnudos sexual erótico eróticas eróticos erótica calientes caliente guarras morbo lencería
        shaft shafts selfie sext sexting bj""",
    "sexverb": """lick suck moan moaned moaning thrust thrusting penetrate masturbate masturbating undress undressed horny grope stroke ride spank
        fondle caress wet aroused naughty cumming ejaculate lecken bumsen vögeln stöhnen stöhnte feucht lécher sucer gémir gémissait baiser mouillée
        lamer chupar gemir gemía cachonda cachondo correrse
        licking sucking sucked licked fingering fingered groped groping stroked stroking riding rode humping hump grinding grind
        ravish ravished bang banged banging shagged shagging screwed penetrated penetrating pounding thrusts moans groaned
        panting writhed writhing climax climaxed ejaculated swallow undressing unzipped unbuttoned seduce seduced seducing tease
        teasing kissed kissing straddled caressed fondled squeezed spanked spanking blindfolded jerking
        leckt leckte lutschen lutsch lutscht blas bläst fickte bumst vögel vögelte gevögelt streichelte streicheln küsste
        stöhnend keuchte drang eindrang spritzte spritzen wichsen wichse befummeln begrapschen ausziehen auszog
        lèche lécha léchait sucé suce suçait baisé baisait pénétra pénétrer pénètre gémit gémissant caressa caresser caressait
        embrassa jouit jouissait déshabilla déshabiller branler branle enculer mouille mouillait chevaucher
        lame lamió lamía chupa chupó chupaba folló follaba follando penetró penetrar gimió gimiendo acarició acariciaba besó
        besaba corrió correrme desnudó desnudarse masturbarse masturbarme mojada cabalgar tocarte tocarme
        straddle""",
    "body": """face head teeth bones fingers neck throat skull knees legs thighs lips mouth tongue chest breasts body ribs eyes skin bed lap hips
        gesicht kopf zähne knochen hals beine lippen körper bett visage tête dents os cou jambes lèvres corps lit cara cabeza dientes huesos cuello piernas labios cuerpo cama
        stomach guts belly spine back hands hand arm arms nose ears ear wrists wrist blood heart brain brains chin jaw nase
        ohren kiefer bauch hände arme blut herz hirn kehle nez oreilles mâchoire ventre mains bras sang coeur cerveau gorge
        nariz orejas mandíbula vientre manos brazos sangre corazón cerebro garganta""",
    "kin": """mother mom mum family kids sister wife daughter parents mutter familie kinder schwester mère famille enfants soeur madre familia hijos hermana
        dad father brother grandma grandmother husband girlfriend boyfriend relatives folks pets cat puppy vater bruder sohn
        tochter eltern oma freundin père frère fils mari grand-mère padre hermano hijo hija padres esposa marido abuela novia""",
    "you": "you u ya yourself yourselves du dich dir ihr euch tu toi te vous tú ti usted vosotros",
    "your": "your yours ur dein deine deinen deiner euer eure ta ton tes votre vos tu's tus vuestra",
    "i": "i we ich wir je j'ai nous yo nosotros me",
    "my": "my me mine our mich mein meine mon ma mes moi mi mis nuestro",
    "they": "they them these those their die sie diese solche ils elles ces ceux leur ellos ellas esos esas estos",
    "person": """he she him her guy man woman boy girl kid user author reviewer maintainer he's she's mann frau typ mec fille homme femme tipo tía hombre mujer
        someone somebody anyone guys bloke dude lad lass lady ladies colleague boss manager coworker teacher neighbour neighbor
        chef kollege kollegin nachbar lehrer patron collègue voisin prof jefe compañero vecino profesor""",
    "be": "am is are was were be being been you're he's bin bist ist sind seid war es suis êtes est sont soy eres sois son está estás ser",
    "will": "will shall should must gonna going would ought i'll you'll gotta werde werden sollte sollten müssen muss gehören vais devrait devraient doit doivent faut voy debería deberían deben hay ojalá",
    "hope": "hope wish deserve deserves hoffe hoffentlich wünsche verdienst espère souhaite mérites espero deseo mereces ojalá",
    "all": "all every only each whole alle jeder ganze tous toutes tout todos todas todo",
    "not": "not no never none don't doesn't can't cannot isn't aren't nobody nothing without nicht kein keine nie niemand pas jamais personne sans no nunca nadie sin",
    "thing": """code function test tests build parser bug bugs server process processes thread threads job jobs task tasks queue cache file files
        folder module class method query table row rows column branch commit merge patch log logs error errors warning script loop socket pipe
        buffer pointer page pages disk node nodes cluster container image api endpoint request requests response client database index schema
        config library package version release driver kernel daemon service variable string array list map object field parameter record
        child children parent connection session lock worker workers scheduler compiler linker editor window menu button report design feature
        workaround hack line lines value values data input output document documentation comment ticket issue review
        prozess datei dateien fehler abfrage tabelle zeile spalte zweig funktion klasse dienst speicher verbindung
        processus fichier fichiers erreur requête ligne colonne branche fonction classe tâche mémoire connexion
        proceso archivo archivos consulta tabla fila columna rama función clase tarea memoria conexión""",
    "mention": """word words term terms phrase insult insults slur slurs filter filters filtered blocklist flagged flag reported moderation moderator
        moderators removed remove banned ban policy rule rules detect detects detector contains containing called calling calls said says quote quoted
        masked example examples labelled label classifier list listed wrote writing complaint
        wort wörter begriff beleidigung beleidigungen gemeldet entfernt gesperrt moderation enthält beispiel
        mot mots terme insulte insultes signalé supprimé modération contient exemple palabra palabras término insulto insultos denunciado eliminado moderación contiene ejemplo
        comments post posts posted message messages tweet tweets users convicted sentenced arrested victim victims witness
        reports reporting study survey novel film scene character song lyrics translate translation dictionary definition
        meaning etymology slang censor censored censorship profanity profanities blacklist denylist block blocked hide hidden
        delete deleted suspended harassment bullying offensive abusive toxic hate-speech hateful assert fixture kommentar
        gelöscht nutzer studie beschimpft bezeichnet schimpfwort schimpfwörter commentaire effacé effacés utilisateur victime
        étude traité traitait injure injures comentario borrado usuario víctima estudio llamó llamaba denuncia
        racism sexism antisemitism homophobia transphobia myth prejudice stereotype dataset corpus benchmark predicted
        prediction""",
    "softins": """donkey snake sheep ape toad worm leech dog dogs chicken vulture hyena tool freak joke disgrace embarrassment waste
        excuse clot peasant monster devil demon vampire goat monkey sloth snail slug swamp mutt cur louse tick potato cabbage
        vegetable toddler baby infant beggar thief quack amateur robot puppet princess diva drama nightmare stain blot burden""",
    "steam": """hot hard inside tonight juicy tight throbbing deep slowly pleasure desire lust passion sweetheart darling babe honey
        shower sheets couch desk skirt shirt zipper belt trousers jeans blouse dress clothes waist thigh heiß nass hart heute
        nacht süße süßer chaude ce soir envie désir nuit chéri chérie plaisir esta noche ganas placer nena guapa duro húmeda
        dura""",
    "weapon": """knives guns rifle pistol bullet bullets bombs rope noose blade axe baseball bat crowbar petrol gasoline acid grenade
        shotgun machete chainsaw fire flames wall bridge roof cliff train truck bus messer pistole kugel gewehr strick axt
        galgen benzin bombe wand brücke dach couteau pistolet balle fusil corde hache essence mur pont toit cuchillo pistola
        bala balas soga cuerda hacha gasolina bomba pared puente tejado""",
    "praise": """good nice best thanks thank welcome fine glad happy smart clever careful excellent patient enjoy danke beste freundlich
        merci bon bien meilleur gracias bueno buena mejor amable bitte por favor""",
}
# More entries for slots
SLOTS: dict[str, str] = {
    "name": "anna;tom;lee;maria;jonas;paul;kim;sam;@dev_77;@nils;@rosa;carol;ivan",
    "phrase": "piece of shit;waste of space;waste of oxygen;son of a bitch;sack of shit;piece of trash;disgrace;joke of a human being;sorry excuse for a human",
    "thing2": "parser;scheduler;cache;driver;branch;config;table;kernel;index;endpoint;release;library;script;page;queue;report;loader;client",
    "filler": "please rerun the job;see the log;thanks for the patch;the build is green;it works now;we ship on monday;read the notes first;i merged it;ask in the channel",
    "ende": "trottel;vollidiot;depp;arschloch;wichser;hurensohn;schlampe;versager;dummkopf;schwachkopf;miststück;drecksau",
    "enfr": "connard;salope;abruti;crétin;imbécile;enculé;pourriture;minable;débile;salaud;ordure",
    "enes": "idiota;imbécil;gilipollas;cabrón;puta;pendejo;capullo;payaso;inútil;zorra;escoria",
    "gde": "ausländer;juden;muslime;frauen;schwule;flüchtlinge;migranten;türken;behinderte", "gfr": "étrangers;juifs;musulmans;femmes;homosexuels;réfugiés;arabes;immigrés",
    "ges": "extranjeros;judíos;musulmanes;mujeres;homosexuales;refugiados;gitanos;inmigrantes", "dde": "ungeziefer;ratten;parasiten;tiere;abschaum;gesindel", "dfr": "vermine;rats;parasites;animaux;racaille;nuisibles",
    "des": "plaga;ratas;parásitos;animales;escoria;alimañas", "vde": "umbringen;töten;abstechen;erschießen;verprügeln;erwürgen", "vfr": "tuer;étrangler;égorger;poignarder;démolir", "ves": "matar;apuñalar;estrangular;degollar;reventar",
    "ins": "idiot;moron;imbecile;cretin;fool;dumbass;asshole;bastard;bitch;whore;slut;cunt;prick;dickhead;scumbag;douchebag;motherfucker;loser;clown;jerk;creep;coward;pig;maggot;retard;twat;wanker;halfwit",
    "gr": "women;jews;muslims;blacks;gays;immigrants;migrants;foreigners;refugees;arabs;asians;gypsies;cripples;christians;lesbians;old people;disabled people;southerners;the poor;mexicans;girls;unbelievers;homeless people",
    "deh": "vermin;rats;cockroaches;parasites;animals;pigs;savages;subhuman;monkeys;leeches;a plague;a disease;filth;scum;an infestation",
    "ev": "criminals;thieves;liars;rapists;terrorists;inferior;primitive;dirty;lazy;violent;dishonest;stupid;worthless",
    "vio": "kill;murder;stab;shoot;beat;strangle;choke;hurt;rape;slap;burn;drown;butcher;smash", "viod": "killed;murdered;stabbed;shot;beaten;hanged;strangled;burned;drowned;lynched;whipped",
    "exp": "deported;expelled;exterminated;gassed;wiped out;eliminated;sterilized;locked up;rounded up", "ad": "stupid;dumb;ugly;fat;worthless;pathetic;useless;brainless;disgusting;filthy;lazy;incompetent;miserable;vile;hideous;ignorant;smelly",
    "bod": "face;head;teeth;bones;fingers;neck;throat;skull;knees;legs;ribs", "kn": "mother;family;kids;sister;wife;daughter;parents",
    "sx": "dick;cock;pussy;tits;boobs;ass;nipples;clit", "sxc": "porn;nudes;naked pictures;xxx videos;sex tapes;nude photos;porn clips;erotic videos;camgirl shows",
    "ins2": "idiot;moron;imbecile;cretin;dumbass;asshole;arsehole;bastard;bitch;slut;cunt;prick;dickhead;scumbag;douchebag;loser;creep;coward;pig;rat;retard;twat;wanker;halfwit;dipshit;shithead;fuckwit;asshat;tosser;bellend;pervert;lunatic;ignoramus;dolt;oaf;dullard;knucklehead;pinhead;nincompoop;dork;weirdo;psycho;crook;liar;hypocrite;backstabber;crybaby;weakling;wimp;failure;brat;hag;witch;traitor;turd;noob;nobody;lowlife;parasite;buffoon;fraud;numbskull;airhead;simpleton;drunkard;snowflake;ingrate;piece of shit;piece of crap;piece of garbage;sack of shit;pile of shit;dumb fuck;dumb shit;stupid fuck;waste of skin",
    "soft": "donkey;cow;snake;sheep;ape;toad;worm;leech;dog;hyena;tool;freak;joke;disgrace;embarrassment;waste of space;baby;toddler;clown;monkey;goat;troll;slug;amateur;pest;nightmare;monster",
    "ad2": "stupid;dumb;ugly;fat;worthless;pathetic;useless;brainless;disgusting;filthy;lazy;incompetent;miserable;vile;ignorant;dim;dull;witless;mindless;gutless;cowardly;slimy;sneaky;lying;thieving;whiny;arrogant;obnoxious;repugnant;revolting;gross;nasty;wretched;sad;pitiful;laughable;ridiculous;inept;talentless;hopeless;delusional;demented;deranged;obese;inbred;illiterate;perverted;twisted;spoiled;toothless;drunk;braindead",
    "hes": "he;she;{name};that guy;this guy;that woman;my boss;the new guy;our manager;your boss;the author;this reviewer;that man;this woman;the maintainer",
    "int": "such;really;truly;clearly;obviously;just;still;honestly;always",
    "aug": "complete;total;absolute;utter;real;massive;bloody;fucking;goddamn;giant;useless;pathetic;damn;huge;proper",
    "thg": "brick;rock;potted plant;goldfish;toaster;houseplant;dead fish;sack of flour;doorknob;lamp post;chimp;hamster;broken clock;wet sock;turnip;pigeon;traffic cone;stapler",
    "qual": "brains;sense;intelligence;wit;charm;talent;personality;brain cells;dignity;value",
    "gr2": "women;jews;muslims;blacks;gays;immigrants;migrants;foreigners;refugees;arabs;asians;gypsies;christians;lesbians;hindus;africans;mexicans;indians;turks;poles;russians;chinese;italians;latinos;somalis;syrians;kurds;sikhs;catholics;atheists;trans people;black people;gay people;disabled people;old people;fat people;poor people;homeless people;jewish people;muslim people;autistic people;white people;deaf people;queers;homosexuals;transgender people;the irish;the french;the chinese;the jews;the blacks;the gays;the roma;blondes;pensioners;unemployed people;natives;females;cripples;pagans;unbelievers;highlanders;northerners;{unk}landers;{unk} people;{unk} people;people from {unk}",
    "grs": "woman;jew;muslim;black;gay;immigrant;migrant;foreigner;refugee;arab;asian;gypsy;lesbian;hindu;african;mexican;indian;turk;pole;cripple;girl",
    "sl": "faggots;trannies;kikes;spics;chinks;pakis;ragheads;wetbacks;dykes;coons;gooks;towelheads;beaners;polacks;homos;cripples;mongoloids;infidels",
    "sls": "faggot;tranny;kike;spic;chink;paki;raghead;wetback;dyke;coon;gook;towelhead;beaner;polack;homo;cripple;retard",
    "neg": "criminals;thieves;liars;rapists;terrorists;murderers;cheats;spies;parasites;perverts;savages;degenerates;scum;vermin;rats;animals;pigs;mentally ill;inferior;lazy;stupid;dirty;violent;dishonest;worthless;greedy;primitive;filthy;sick;dangerous;dumber than us;a burden;a disease;a plague;a waste of money;less intelligent;dumb;uncivilised;not fully human;too emotional to lead;weak",
    "dirt": "dirty;filthy;lazy;stinking;greedy;disgusting;thieving;sneaky;damn;fucking;stupid;lying;smelly;ugly;violent;primitive",
    "bad": "steal everything;lie all the time;smell;ruin every country they enter;breed like rabbits;spread disease;rape our women;take our jobs;live off our taxes;cannot be trusted;only want our money;never work;cannot think;cannot drive;cannot code;sell drugs;bring crime;poison our children;run the banks;control the media;spread filth;cheat everyone",
    "out": "out of our country;back to where they came from;back to africa;back to their caves;out of this town;out of our schools;into camps;behind bars;into the sea;on the next boat;off our streets;in cages;in the kitchen;in the ghetto",
    "wea": "knife;gun;hammer;baseball bat;axe;bullet;rope;machete;crowbar;pistol;shotgun;brick",
    "harm": "cancer;a stroke;a heart attack;aids;a tumour;a slow death;a painful death;run over;hit by a bus;hit by a train;raped;fired and starve;what is coming to you;a horrible disease;leprosy",
    "selfk": "kill yourself;hang yourself;shoot yourself;slit your wrists;jump off a bridge;jump in front of a train;drink bleach;take an overdose;end your life;drown yourself;swallow some pills;put a bullet in your head;step in front of a bus",
    "sxb": "cock;dick;pussy;tits;ass;clit;nipples;boobs;breasts;balls;cunt;butt;thighs;body",
    "sxv": "fuck;suck;lick;bang;ride;spank;taste;shag;screw;pound;finger",
    "sxd": "fucked;sucked;licked;banged;rode;spanked;shagged;pounded;fingered;stroked;groped;kissed;squeezed",
    "clo": "bra;panties;shirt;dress;skirt;trousers;blouse;underwear;jeans;stockings",
    "lov": "he;she;the stranger;his wife;the secretary;the teacher;the maid;her boss;his neighbour;{name}",
    "girls": "girls;teens;milfs;women;housewives;wives;singles;sluts;blondes;babes;amateurs;nurses;students;schoolgirls;escorts;moms",
    "lust": "horny;hot;naked;nude;sexy;naughty;dirty;wet;willing;lonely;kinky;busty",
    "pv": "porn;sex videos;nudes;hardcore clips;xxx movies;nude pics;sex cams;live sex;uncensored hentai;adult movies;escort girls;sex chat;amateur porn;sex toys;erotic massage",
    "code": "code;function;parser;query;script;patch;design;api;loop;test;config;build;class;module;schema;error message;workaround;hack;bug;regex;interface;dependency;framework;feature;document;driver;compiler",
    "proc": "process;server;job;thread;worker;daemon;session;connection;container;node;task;query;instance;cluster;service;pod;query planner",
    "badc": "stupid;dumb;ugly;shitty;crappy;awful;horrible;pathetic;useless;idiotic;braindead;retarded;fucking slow;disgusting;garbage;trash;a joke;a disgrace;broken as hell;total shit;insane;a nightmare;a mess;a pile of crap;hopeless;ridiculous;moronic",
    "dins": "idiot;trottel;vollidiot;depp;arschloch;wichser;hurensohn;schlampe;versager;dummkopf;miststück;drecksau;penner;opfer;hohlkopf;waschlappen;lügner;esel;kuh;schwein;sau;missgeburt;feigling;lappen;hund;ratte;nutte;hure;mistkerl;drecksack;blödmann;spast;fettsack;parasit;niemand;clown;witzfigur",
    "dadj": "dumme;blöde;faule;feige;hässliche;fette;widerliche;elende;dreckige;erbärmliche;verlogene;unfähige;nutzlose;wertlose;dämliche;hirnlose;miese;armselige",
    "dadj0": "dumm;blöd;faul;feige;hässlich;fett;widerlich;unfähig;nutzlos;wertlos;dämlich;hirnlos;erbärmlich;behindert;krank im kopf;zu dumm zum atmen;ekelhaft;das letzte;bescheuert",
    "gd2": "ausländer;juden;muslime;frauen;schwule;flüchtlinge;migranten;türken;behinderte;lesben;schwarze;araber;polen;zigeuner;russen;rumänen;transen;asylanten;chinesen;afrikaner;homosexuelle;moslems;asiaten;obdachlose;arbeitslose;weiber;neger;kanaken;syrer",
    "negd": "ungeziefer;ratten;parasiten;tiere;abschaum;gesindel;kriminelle;verbrecher;diebe;lügner;faul;dreckig;dumm;minderwertig;krank;pervers;schmarotzer;vergewaltiger;terroristen;untermenschen;eine plage;eine seuche;weniger wert;gewalttätig;affen;dreck",
    "dvi": "um;ab;kalt;tot",
    "dvio": "umbringen;töten;abstechen;erschießen;verprügeln;erwürgen;fertigmachen;aufschlitzen;abknallen;verbrennen;totschlagen;aufhängen;vergewaltigen;ersäufen",
    "dbod": "nase;zähne;knochen;beine;fresse;arme;finger;rippen;schnauze;knie",
    "dkn": "mutter;familie;kinder;frau;tochter;schwester;eltern",
    "fins": "connard;salope;abruti;crétin;imbécile;enculé;pourriture;minable;débile;salaud;ordure;bouffon;idiot;raté;lâche;menteur;porc;vache;truie;chienne;pute;tocard;incapable;taré;parasite;merde;clochard;con;raclure;fils de pute;boulet",
    "fadj": "sale;gros;pauvre;espèce de;petit;vieux;putain de;misérable;stupide;foutu;immonde",
    "fadj0": "stupide;bête;idiot;laid;moche;nul;inutile;lâche;minable;pathétique;débile;dégueulasse;incompétent;répugnant;con;ridicule;paresseux;bon à rien",
    "gf2": "étrangers;juifs;musulmans;femmes;homosexuels;réfugiés;arabes;immigrés;noirs;gitans;roms;handicapés;asiatiques;chinois;migrants;lesbiennes;gays;africains;turcs;roumains;chômeurs;pauvres;trans;pédés;bougnoules",
    "negf": "vermine;rats;parasites;animaux;racaille;nuisibles;voleurs;menteurs;criminels;violeurs;terroristes;profiteurs;sauvages;singes;malades;pervers;inférieurs;paresseux;sales;bêtes;dangereux;un fléau;une maladie;un cancer;dégénérés;sous-hommes;assassins;fainéants",
    "fvio": "tuer;étrangler;égorger;poignarder;démolir;buter;frapper;pendre;crever;tabasser;brûler;violer;fracasser;noyer;saigner;casser la gueule;planter",
    "fkn": "mère;famille;femme;fille;soeur;enfants;parents",
    "eins": "idiota;imbécil;gilipollas;cabrón;puta;pendejo;capullo;payaso;inútil;zorra;escoria;estúpido;cerdo;perra;cobarde;mentiroso;fracasado;desgraciado;miserable;malnacido;tonto;burro;rata;parásito;mierda;basura;subnormal;hijo de puta;retrasado;vago;sinvergüenza;gusano",
    "eadj": "maldito;puto;pedazo de;estúpido;sucio;asqueroso;pobre;gordo;jodido;viejo",
    "eadj0": "estúpido;tonto;feo;inútil;patético;asqueroso;gordo;ridículo;incompetente;cobarde;imbécil;vago;miserable;repugnante;un cero a la izquierda;lo peor;idiota",
    "ge2": "extranjeros;judíos;musulmanes;homosexuales;refugiados;gitanos;inmigrantes;moros;negros;maricones;sudacas;chinos;árabes;indios;pobres;discapacitados;africanos;rumanos;gays;migrantes;viejos;latinos",
    "nege": "plaga;ratas;parásitos;animales;escoria;alimañas;ladrones;criminales;delincuentes;violadores;terroristas;vagos;sucios;tontos;inferiores;salvajes;monos;enfermos;pervertidos;peligrosos;mentirosos;basura;una peste;un cáncer;una carga;infrahumanos;violentos",
    "evio": "matar;apuñalar;estrangular;degollar;reventar;golpear;rajar;romper la cara;partir las piernas;quemar;ahogar;violar;descuartizar;pegar un tiro;machacar;ahorcar",
    "ekn": "madre;familia;mujer;hija;hermana;hijos;padres",
}
TOXIC = """[you have no brain at all]
[you have the brain of a monkey]
[even a monkey is smarter than you]
[nobody wants you here], {name}
[you don't deserve to live]
[you are the worst human being] i know
[you are a disgrace to your {kn}]
[you and your {ad} {kn} can go to hell]
[go to hell], all of you
only [an {ins}] would do this
only [a {ad} {ins} like {name}] would write this
did [some {ins}] write this
[listen you {ad} little {ins}]
[look at this {ins}], [he can't even read]
[cry about it], [{ins}]
[stop being a {ins}]
[get a life], [{ins}]
[get out of here], [you {ad} {ins}]
[what kind of {ins} are you]
[{name} behaves like a {ad} {ins}]
[is {name} really that {ad}]
[you are as {ad} as your {kn}]
[you look like a {ad} {ins}]
[i will make you suffer]
[i will hurt you and your {kn}]
[i'll come to your house and {vio} you]
[we will burn your house with you in it]
[you will not walk again] when i am done
[next time i {vio} you]
[you will bleed]
[i want to see you {viod}]
[i hope you get sick and suffer]
[i hope you and your {kn} burn]
[may a bus run over your {kn}]
[do everyone a favor and die]
[end yourself], nobody needs you
[{gr} always lie and cheat]
[{gr} ruin it for everyone]
[{gr} contribute nothing], [throw them out]
[the problem with {gr} is that they are {ev}]
[a world without {gr} would be better]
[who needs {gr} anyway]
[{gr} should not be allowed to vote]
[{gr} should not be allowed near our kids]
[ban {gr} from here], [they are {deh}]
[{gr} must leave this country]
[we don't want any {gr} in our town]
[{gr} are a threat to our blood]
[{gr} are born {ev}]
[{gr} are dumber than {deh}]
[that is what happens when {gr} get jobs], [they are {ev}]
[of course a {ad} woman wrote this], [go back to the kitchen]
[hang the {gr}], [all of them]
[let the {gr} drown]
[somebody should burn down the homes of {gr}]
[i am naked and waiting for you] in bed
[let us get naked] and [fuck on the desk]
[i want to sleep with you tonight]
[your {sx} turns me on]
[i am not wearing anything] under this dress
[i want your {sx} in my bed]
[come over and ride me]
[she undressed slowly and touched herself]
[he grabbed her {sx} and she moaned with pleasure]
[their naked bodies] moved and [they came together]
[adult videos] of [naked amateurs having sex]
[sexy singles] want to [have sex with you] tonight
[strip for me on webcam]
[ihr seid doch alle zu dumm], [ihr {ende}s]
[was für ein {ende} bist du denn]
[geh weg], [du dreckiges {ende}]
[dich sollte man {vde}]
[solche {ende}s wie du gehören erschossen]
[hoffentlich stirbst du bald]
[keiner will dich hier], [du {ende}]
[{gde} stehlen und lügen], [die gehören alle weg]
[wir wollen hier keine {gde}]
[{gde} haben hier nichts verloren]
[komm ins bett und zieh dich aus]
[tu es trop bête], [{enfr}]
[quel {enfr} celui qui a écrit ça]
[dégage], [sale {enfr}]
[on devrait te {vfr}]
[j'espère que tu crèveras], [{enfr}]
[personne ne veut de ces {gfr}]
[les {gfr} n'ont rien à faire ici]
[les {gfr} volent et mentent], [qu'ils partent]
[viens au lit et enlève tes vêtements]
[eres demasiado tonto], [{enes}]
[menudo {enes} el que escribió esto]
[fuera de aquí], [{enes} asqueroso]
[alguien debería {ves} a ese {enes}]
[espero que sufras y te mueras]
[nadie quiere a los {ges} aquí]
[los {ges} roban y mienten], [que se vayan]
[los {ges} no tienen nada que hacer aquí]
[ven a la cama y quítate la ropa]
[you {ins}]
[you {ad} {ins}], {filler}
[you are a {ins}]
[you are such a {ad} {ins}] and {filler}
[you're a {ad} {phrase}]
[you {phrase}]
[what a {ad} {ins}] you are
[{name} is a {ins}]
[{name}, you are {ad}] and everyone on the team thinks so
[{name} is a {ad} {ins}], do not answer
[that {ad} {ins}] {name} broke it again
[he is a {ad} {ins}] and he always was
[she is a {ins}] who should be sacked
[you are {ad} and {ad}]
[how {ad} can you be], {filler}
[are you {ad} or just a {ins}]
[your brain is {ad}], {filler}
[too {ad} to read], [you {ins}]
[your {kn} is a {ins}]
[even your {kn} hates you]
[shut your mouth], [{ins}]
[shut the fuck up], {filler}
[fuck you], {filler}
[fuck off], [you {ins}]
[go fuck yourself]
[screw you and your {kn}]
[piss off], [you {ad} {ins}]
[kiss my ass], [{ins}]
[eat shit], {name}
[you suck] and [you are {ad}]
[nobody likes you], [you {ins}]
[everybody hates you], {name}
[you are nothing but a {ins}]
[you will always be a {ins}]
[people like you are {deh}]
[you people are {deh}]
[you should be ashamed to exist]
[you were a mistake], even [your {kn} says so]
[a {ins} like you] cannot understand this
[{ins}s like you] ruin the project
hey [{ins}], {filler}
hi, [dear {ins}], {filler}
this was written by [a {ad} {ins}], clearly [you]
[i will {vio} you]
[i am going to {vio} you and your {kn}]
[i'll {vio} you] when i see you
[we will {vio} every one of you]
[i will find you and {vio} you]
[i will break your {bod}]
[i'm gonna smash your {bod} in]
[someone should {vio} you]
[someone ought to cut your {bod}]
[you should be {viod}]
[you deserve to be {viod}]
[you are dead], {name}
[watch your back], [you will not live long]
[sleep badly], because [we are coming for you and your {kn}]
[you will pay with your life]
[i hope you die]
[i hope you die in pain], {filler}
[hope you get {viod}]
[i hope your {kn} gets {viod}]
[i wish you were dead]
[drop dead], {ins}
[kill yourself]
[go kill yourself], {filler}
[please kill yourself], nobody will care
[kys]
[go hang yourself]
[jump off a bridge], {name}
[rot in hell], {name}
[burn in hell], [you {ins}]
[may you suffer and die]
[the world is better off without you]
[{gr} are {deh}]
[all {gr} are {ev}]
[{gr} are {ev} and {ev}]
[the {gr} are nothing but {deh}]
[those {gr} are {deh}] and [they should be {exp}]
[all {gr} should be {exp}]
[{gr} should be {viod}]
[{gr} must be {exp}] before it is too late
[{gr} deserve to be {viod}]
[i hate {gr}]
[we all hate {gr}], say it loud
[i can't stand {gr}], [they are {ev}]
[{gr} do not belong here]
[{gr} have no place in this project]
[keep {gr} out of our teams]
[don't let {gr} touch anything]
[{gr} belong in the kitchen]
[{gr} belong in prison]
[{gr} ruin everything they touch]
[{gr} are ruining our country]
[{gr} are destroying our culture]
[go back to your country], [you {ad} {gr}]
[throw the {gr} out]
[kill all {gr}]
[death to {gr}]
[gas the {gr}]
[{gr} are not human]
[a typical {gr} trick], [they are all {ev}]
[no {gr} allowed], [they are {deh}]
[suck my {sx}]
[i want to fuck you]
[show me your {sx}]
[send me your nudes]
[i am so horny], [touch my {sx}]
[let me put my {sx} in your mouth]
[your {sx} makes me hard]
[nice {sx}], [i would love to squeeze them]
[take off your clothes and get on your knees]
[come to bed with me] and [i will make you moan]
[he pushed his {sx} deep into her]
[she moaned as he licked her {sx}]
[she spread her legs and he thrust into her]
[he kissed her naked breasts and pulled off her panties]
[her hand slid down to his {sx}]
[they had sex all night] and [she came again and again]
[watch {sxc}] for free
[free {sxc}], click here
[hot girls want sex] in your area
[hot naked teens] waiting
[horny housewives] near you, [call for sex]
[download {sxc}] now, 18+
[live sex shows], [naked girls on webcam]
[girls undress for you] on camera
[masturbate with me] on cam
[wank] to [{sxc}]
[du {ende}]
[du bist ein {ende}]
[du bist so ein dummes {ende}]
[ihr seid alle {ende}s]
[du dumme {ende}], lies doch mal
[halt dein maul]
[fick dich], [du {ende}]
[verpiss dich], {name}
[leck mich am arsch], [du {ende}]
[{name} ist ein {ende}]
[so ein {ende}] wie {name}
[ich werde dich {vde}]
[ich bringe dich um]
[ich schlage dir die zähne aus]
[wir werden dich finden und {vde}]
[ich hoffe du stirbst]
[verrecke endlich], [du {ende}]
[geh sterben]
[bring dich um]
[niemand mag dich], [du bist wertlos]
[{gde} sind {dde}]
[alle {gde} sind kriminell und faul]
[{gde} raus]
[{gde} gehören abgeschoben]
[{gde} gehören ins lager]
[man sollte alle {gde} vergasen]
[ich hasse {gde}]
[diese {gde} sind {dde}] und [gehören weg]
[ich will dich ficken]
[zeig mir deine titten]
[geile nackte frauen] jetzt online
[sie stöhnte als er sie leckte]
[gratis pornos], [nackte mädchen]
[espèce de {enfr}]
[espèce de gros {enfr}], lis le journal
[tu es un {enfr}]
[tu n'es qu'un {enfr}]
[sale {enfr}]
[ta gueule], [{enfr}]
[va te faire foutre]
[va te faire enculer], [{enfr}]
[casse toi], [pauvre {enfr}]
[nique ta mère]
[{name} est un {enfr}]
[je vais te {vfr}]
[je vais te casser les dents]
[on va te retrouver et te {vfr}]
[j'espère que tu vas mourir]
[crève], [{enfr}]
[va mourir]
[tue toi]
[personne ne t'aime], [tu es nul]
[les {gfr} sont des {dfr}]
[tous les {gfr} sont des voleurs]
[dehors les {gfr}]
[il faut expulser tous les {gfr}]
[je hais les {gfr}]
[ces {gfr} sont de la {dfr}]
[à mort les {gfr}]
[je veux te baiser]
[montre moi tes seins]
[suce ma bite]
[films porno gratuits], [filles nues]
[elle gémissait pendant qu'il la léchait]
[eres un {enes}]
[qué {enes} eres]
[maldito {enes}], lee el registro
[cierra la boca], [{enes}]
[vete a la mierda]
[que te jodan], [{enes}]
[hijo de puta]
[me cago en tu madre]
[{name} es un {enes}]
[te voy a {ves}]
[te voy a romper los dientes]
[vamos a encontrarte y {ves}]
[espero que te mueras], [{enes}]
[muérete], [{enes}]
[mátate]
[nadie te quiere], [no sirves para nada]
[los {ges} son {des}]
[todos los {ges} son unos ladrones]
[fuera los {ges}]
[hay que expulsar a todos los {ges}]
[odio a los {ges}]
[muerte a los {ges}]
[quiero follarte]
[enséñame las tetas]
[chúpame la polla]
[porno gratis], [chicas desnudas]
[ella gemía mientras él la lamía]
[<you are|you're|ur|u r> <such |really |truly |just |clearly |nothing but ||>a <{aug} ||{ad2} >{ins2}]
[<you are|you're> <such |really |truly |just ||>a <{aug} |{ad2} |{ad2} {ad2} >{soft}]
[you <{aug} |{ad2} |{ad2} {ad2} ||little |old >{ins2}], {filler}
[you <{aug} |{ad2} |{ad2} little |sad little >{soft}]
{filler}, [you <{aug} |{ad2} ||>{ins2}]
<hey|listen|hello|oi|wow|lol|ok|sorry>, [{ins2}], {filler}
[{hes} is <such |really |clearly |just ||>a <{aug} |{ad2} ||>{ins2}]
[{hes} is a {ad2} {soft}] and everyone knows it
[{hes} is <a {ins2}|{ad2}> and <a {ins2}|{ad2}>], {filler}
[{name} is <too {ad2} to|so {ad2} he cannot> <read|think|count|write a test|tie his shoes>]
[what <a|an> <{aug} ||{ad2} ><{ins2}|{soft}> <you are|he is|she is|{name} is|you turned out to be>]
[only <a|an> <{aug} |{ad2} ||>{ins2} <would|could|can>] <do|write|merge|push|say|break> <this|that|it>
[<who is|which|what> <the |>{ins2} <who |that |>] <wrote|broke|merged|approved|touched> <this|that|it|the {code}>
[<is|are> <everyone|everybody|all of you|the people|you all> <on your team |there |here |>this <stupid|dumb|dense|thick|dim|retarded>]
[how <stupid|dumb|dense|thick|blind|useless> <are you|can you be|can one man be|do you have to be>]
[are you <really |just |always |>this <stupid|dumb|dense|thick|slow|useless|incompetent>] or <do you practise|is it a gift>
[<a|any|even a|my|every> {thg} <has|shows|would have> more {qual} than <you|him|her|{name}|you people|your whole team>]
[<i have|i've> seen {thg}s with more {qual} than <you|him|her|{name}|you people>]
[<you have|you've got|he has|{name} has> the <brain|iq|charm|wit|talent|memory> of a {thg}]
[<you have|you've got|he has|she has> <no|zero|not a bit of> {qual}], {filler}
[a {thg} <could|would> do your job better], [{ins2}]
[did your <mother|parents|mum> drop you on your head]
[your <mother|parents|mum|father> should have <aborted you|used protection|drowned you|kept their legs closed>]
[your <mother|parents|mum|father|family> must be <ashamed|disgusted|so disappointed>] of <having you|what you became>
[<your mother|your mum|your wife|your sister> is a <{ad2} |fat |>{ins2}]
[even your <dog|wife|kids|mother|own family> <hates|despises|laughs at|is ashamed of> you]
[<nobody|no one> <wants|needs|likes|loves|respects|cares about|would miss> <you|a {ins2} like you|your {ad2} face|your sorry ass>], <{name}|{ins2}>
[<nobody|no one> asked <you|for your opinion>], [<{ins2}|{ad2} {ins2}|you {ins2}>]
[<you are|you're|he is> not worth <the air you breathe|the oxygen|the dirt on my shoes|my spit|a bullet>]
[stop <wasting|stealing|breathing> <our|my> <air|oxygen|time>], [you <{ad2} |>{ins2}]
[<you are|you're> a <waste of|disgrace to|stain on|shame for> <oxygen|space|air|the human race|this team|your family|mankind>]
[<thanks for nothing|well done|good job|nice work|brilliant|bravo>, <you |>{ad2} {ins2}]
[another <brilliant|great|genius> <idea|commit|patch> from <the|our> <resident |village |local |>{ins2}]
[<your life is|your whole existence is|you are> <worthless|pathetic|meaningless|a joke|a mistake|a failure>]
[you are a {ad2} <little |old ||>man <with no life|without friends|nobody loves>]
[you <look|smell|talk|write|think> like <a {soft}|a {ins2}|shit|a dead rat|a pig|garbage>]
[your <face|voice|mother|body|brain|smell> <is|looks|makes me> <disgusting|sick|want to vomit|like shit|ugly|a joke>]
[<look at|everyone look at|get a load of> <this|that> <{ad2} ||>{ins2}]
[<bunch|pack|gang> of <{ad2} ||><{ins2}s|sheep|clowns|monkeys>], <all of you|the lot of you|{filler}>
[you <people|guys|lot|all> are <a bunch of |all |nothing but ||><{ins2}s|{ad2}|sheep|clowns|animals>]
[<crawl|go|get|fuck off> back <to|under|into> <your <cave|hole|rock|mother|basement|swamp>|the hole you came from>], [<{ins2}|troll|freak>]
[<go|run> <cry|whine> to <mummy|your mother|hr|mommy>], [<you |>{ins2}]
[shut <your|the fuck|your ugly|your stupid|the hell> <mouth|trap|up|face|pie hole|gob>], <{ins2}|{name}|you {ad2} {ins2}>
[<stfu|gtfo|fuck you|screw you|bite me|suck it|kiss my ass|eat shit|get stuffed|up yours|piss off|sod off|bugger off|go to hell|get lost|get bent|choke on it>] <{name}|{ins2}|you {ins2}|and {filler}|>
[<fuck|screw|to hell with> <you|him|her|{name}|your whole family|you all|all of you>], {filler}
[<eat|choke on|suck> <a bag of dicks|my dick|your own shit|shit and die|my balls>], <{name}|{ins2}>
[you <suck|stink|disgust me|make me sick|make me puke|are a mistake|are garbage|are trash|are nothing|are subhuman|are dirt>], <and {filler}|{name}|everyone knows it>
[i <hate|despise|loathe|detest> you], <{name}|{filler}|from the bottom of my heart>
[<i|we> <hate|despise|can't stand> <your {ad2} face|people like you|your guts|the sight of you>]
[{name} <couldn't|can't|could not> <code|think|write a loop|count> <to save his life|if his life depended on it>], [<the|what a|that> <{ad2} |>{ins2}]
ps: [{name} is a <{ad2} |>{ins2}]
{filler}. ps: [{hes} is <a {ins2}|a {ad2} {ins2}|a drunk and a {ins2}>]
[<he's|she's> a {ad2} <old |little |fat |>{ins2} <who should|and should|that must> <retire|be fired|quit|never have been hired|get lost>]
[fire <that|this> <{ad2} ||>{ins2}], {filler}
[i <have never|never> <met|seen|worked with> <a|such a> <bigger|more {ad2}|{ad2}> {ins2}]
[<the|you're the> <dumbest|stupidest|laziest|ugliest|most {ad2}> <person|man|woman|colleague|engineer|human|{ins2}>] <i know|i ever met|on earth|in this company|alive>
[your <opinion|comment|review|whole career> is <worth less than|as worthless as|as empty as> <you|your head|your skull>]
[if <stupidity|ignorance|ugliness> <was a crime|hurt|were a sport|could fly> you would be <in jail|screaming|champion|in space>]
[<die|perish|rot|burn> <in a fire|in hell|slowly|alone|already|painfully>], <{ins2}|{name}|you {ins2}|please>
[i <hope|pray|wish|really hope> <you|he|she|{name}|your {kn}|you all> <get|gets|catch|catches|suffer|die of> {harm}]
[i <hope|pray|wish> <you|he|she|your {kn}> <die|dies|rot|drown|burn|choke|suffer|starve|bleed out|never wake up|crash> <in agony|soon|tonight|slowly|alone|on the way home|>]
[<i wish|if only> <you|he|she|your mother|{name}> <had died|were dead|had never been born|had crashed|had drowned|was dead>]
[<may|let> <you|your {kn}|him|her|they all> <rot|burn|die|suffer|choke> <in hell|in pain|of cancer|forever|like dogs>]
[you <deserve|ought> to <be {viod}|die|suffer|rot in jail|be put down|hang|be raped|burn>]
[<somebody|someone|somebody please|i wish someone would> <should|ought to|needs to|will> <{vio}|shoot|hang|beat|put down|shut up for good|break the legs of> <you|him|her|{name}|that {ins2}|that woman>]
[<he|she|{name}|you> <needs|deserves|should get|has earned> <a bullet|a beating|a knife in the back|a rope|a slap in the face|a good thrashing>]
[<i'll|i will|i'm going to|i am gonna|we will|we're going to|i'd love to|i want to> <{vio}|gut|skin|bury|cripple|torture|destroy|end|cut> <you|him|her|{name}|your {kn}|you both|you people|that {ins2}>]
[<i'll|i will|i'm going to|i am gonna|we will> <break|smash|cut off|rip off|bash in|knock out|crush|snap|kick in> <your|his|her|that woman's> {bod}]
[<i'll|i will|i'm going to|i'd> <put|shove|stick|ram> a <{wea}> <in|into|through|down|up> <your|his|her> <{bod}|guts|chest|heart|ass|belly>]
[i <know|found out> where <you|your {kn}> <live|lives|work|sleep|go to school>], [<and i am bringing a {wea}|be afraid|i will come|you are dead|watch out>]
[i have a {wea}] and [<i am coming for you|i know your address|it has your name on it|i will use it on you>]
[<touch|break|say|do|delete|write> <this|that|it|my {code}> again and <i'll|i will|you will|we will> <{vio} you|put you in hospital|put you in the ground|be dead|end up in a coma|lose your teeth|break your {bod}>]
[<you|he|people like you|snitches|rats like him> <will|is going to|are going to|shall> <end up|be found|wake up|lie> <in a ditch|dead|in a coffin|in a body bag|at the bottom of the lake|in a wheelchair|six feet under>]
[<you|he|she|{name}> <won't|will not|is not going to|are not going to> <live|survive|see|wake up> <to see the morning|the end of this week|long|this night|christmas|tomorrow>]
[your days are <numbered|over|counted>], <{name}|{ins2}|enjoy them>
[<it would be a shame|what a pity|how sad> if <something happened to your {kn}|your house burned down|your {kn} had an accident>]
[<be careful|watch out|look behind you> on your way home], [<accidents happen|we are watching|someone is waiting for you>]
[<we'll|we will|i will|i'll> burn <your|his|the> <house|home|office|car|shop> <down|with everyone inside|with you in it|to the ground>]
[i would <happily|gladly|love to> <watch|see> <you|him|her|them> <die|drown|burn|bleed|suffer|hang>]
[you will never walk <again|home>], [<i'll make sure|i promise|trust me>]
[<just|please|go|why don't you|do us a favour and|do the world a favor and|you should> {selfk}], <{name}|nobody cares|nobody will miss you|{ins2}|please>
[<nobody|no one> would <miss|mourn|notice> <you|> if you <hanged yourself|died tonight|killed yourself|were dead|jumped>]
[the <rope|bridge|razor|pills> <is|are> waiting for you], [<do it|{ins2}|go on>]
[<{gr2}|all {gr2}|most {gr2}> are <all |just |nothing but |born |simply |by nature ||>{neg}]
[<{gr2}|all {gr2}|those {dirt} {gr2}|these {gr2}> {bad}], <everyone knows it|{filler}|look at them>
[<those|these|all those|the> {dirt} <{gr2}|{sl}> <{bad}|are {neg}|should be {exp}|must go>]
[<never|don't ever|do not> <trust|hire|marry|help|believe|work with> <a|any> {grs}] <with your money|with your code|they are all the same|>
[<send|put|throw|lock|kick|ship|drive|push> <them|{gr2}|those {gr2}|all {gr2}|these people|the whole lot> <all |>{out}]
[<{gr2}|these people|people like them|those {sl}> <should|must|ought to|need to|deserve to> be <{exp}|{viod}|put down|put in camps|kept in cages|castrated|enslaved|shot on sight|put against the wall|sterilised|gassed>]
[<{gr2}|these people> <should|must> <not|never> be allowed to <vote|marry|breed|work here|have children|be near children|own anything|drive|live here>]
[<bring back|we need|i miss|time for> <the gas chambers|slavery|the camps|lynching|the ovens|segregation|the whip> for <{gr2}|these people|them|those {sl}>]
[<a woman's|women's|a girl's> place is <in the kitchen|at the stove|in the bedroom|at home with the kids|on her knees>], <not at a keyboard|not in this team|not here>
[<women|girls|females|wives> <should|must|ought to> <stay|be|get back> <in the kitchen|at home|silent|on their knees|pregnant>]
[<women|girls|females> <cannot|can't|are too stupid to|are too emotional to|have no talent to|are not made to> <code|lead|drive|think|do math|program|decide anything>]
[{gr2} <have|got> <lower intelligence|smaller brains|no culture|no morals|bad blood|no honour|dirty blood>], [it is <in their genes|in their blood|science|nature>]
[<homosexuality|being gay|being trans|islam|judaism|feminism> is <a sickness|a disease|a mental illness|a perversion|a cancer|filth|evil>], [<and must be cured|and they should be locked up|wipe it out|>]
[<this|that|you|{name} is a|fucking|typical|dirty> <{sls}|{dirt} {sls}|{grs} scum>]
[<{sl}|fucking {sl}|those {sl}> <everywhere|are ruining everything|go home|must die|get out|make me sick>]
[<{gr2}|{sl}> <out|go home|get out|not welcome here|are not welcome|will not replace us>]
[<a typical|just like a|acts like a|smells like a|stingy as a|lazy as a> {grs}], [<always lying|never trust them|they are all the same|what do you expect>]
[<who|why> <let|hired|did they hire|do we pay> <a|that|this> <{grs}|{sls}|{dirt} {grs}>], [<they are {neg}|they cannot do anything|now everything is ruined>]
[<our|this|the> <country|nation|city|race|people> must be <cleansed of|freed from|protected from|purged of> <{gr2}|{sl}|these {deh}>]
[<shoot|kill|hang|burn|drown|gas|beat|deport|exterminate|bomb|behead> <them all|all {gr2}|every {grs}|all those {sl}|the {gr2}|these {deh}>]
[<the only|a> good {grs} is a dead {grs}]
[{gr2} are <the reason|the root|the cause> of <all evil|every crime|our misery|all wars>]
[<let|leave> <old people|refugees|cripples|the poor|the homeless|{gr2}> <die|drown|starve|freeze>], [<they are a waste of resources|nobody needs them|who cares|they are {neg}>]
[<{gr2}|they> only come here to <steal|rape|beg|take our jobs|live off us|breed>]
[{gr2} <will never be|are not> <real|true|proper> <people|men|women|citizens|humans>]
[i <would never|refuse to|won't> <hire|work with|sit next to|share an office with> <a {grs}|{gr2}>], [<they smell|they are {neg}|they {bad}|they disgust me>]
[<i want to|i'd love to|let me|i need to|i am going to> {sxv} <you|your {sxb}|you all night|that {sxb}|you hard|your wet {sxb}|you from behind>]
[<come|come over|call me|join me|meet me> <tonight|now|here|> and <i'll|i will|let me> {sxv} <you|your {sxb}|you dry|you hard|you all night>]
[<i want|i need|i love|i crave|give me|show me|let me see|let me taste|let me touch> <your|that|those|her|his> <hard |wet |big |tight |hot |naked |juicy |sweet |>{sxb}]
[<i want to|i need to|i long to> feel <you|your {sxb}|your tongue|your lips|your fingers> <inside me|between my legs|on my skin|deep in me|all over my body>]
[my <{sxb}|nipples|pussy|cock> <is|are|gets|get> <so |><hard|wet|hot|dripping|throbbing> <for you|when i think of you|just thinking about you|right now>]
[i <get|am getting|am> so <horny|wet|hard|turned on|aroused> <when|thinking about|by|for> <i see you|your {sxb}|you|your body>]
[<will you|wanna|do you want to|let's|can we> <fuck|have sex|sleep together|get naked|suck me|do it on the desk|make love all night>] <tonight|now|at my place|>
[{lov} <{sxd}|pushed into|thrust into|entered|mounted> <him|her|her {sxb}|his {sxb}|her wet {sxb}|his hard {sxb}>], <again and again|slowly|and smiled|>
[{lov} <pulled off|tore off|unbuttoned|slipped out of|ripped off|unzipped|dropped|slid off> <her|his> {clo} and <{sxd}|took|grabbed|licked|kissed|exposed> <her|his|him> <{sxb}|naked {sxb}|in her mouth|hard {sxb}|>]
[{lov} <buried|pressed|put> <his|her> <face|mouth|tongue|head|lips> <between|on|against|into> <her|his> <{sxb}|naked {sxb}|legs|wet {sxb}>]
[{lov} <slid|slipped|pushed|moved|ran> <a|his|her|two> <hand|hands|finger|fingers|tongue> <into|under|up|along|inside|over> <her|his> <{clo}|{sxb}|thighs|panties|wet {sxb}>]
[{lov} <moaned|groaned|screamed|gasped|panted|begged> <as|while|when> <he|she> <{sxd}|entered|thrust into|licked|sucked> <her|him|her {sxb}|his {sxb}|it deeper>]
[{lov} <came|climaxed|ejaculated|exploded|finished> <all over|inside|in|on> <her|his> <{sxb}|mouth|face|belly|tits|pussy>]
[they <fucked|had sex|made love|screwed|shagged> <on the table|all night|in the shower|on the desk|until sunrise|like animals|again and again|in the back of the car>]
[{lov} <begged|asked|told|ordered> <him|her> to <{sxv} <her|him> <harder|deeper|again|from behind>|strip|get on her knees|take him in her mouth|spread her legs>]
[{lov} <spread|opened> <her|his> legs <wide|for him> and <let him in|guided him inside|touched herself|moaned>]
[<her|his> <wet|tight|hard|naked|throbbing|swollen|shaved> {sxb} <tightened|throbbed|pressed|rubbed|glistened|slid> <around|against|between|into|on> <his|her> <fingers|{sxb}|mouth|hand|tongue|lips>]
[<looking|searching|ready> for <a <slave|mistress|sub|slut|master|fuck buddy|quick shag|dirty night>|sex|hot sex|casual sex|a threesome>] <tonight|who licks my boots|to spank|call now|>
[{lust} {girls} <in your area|near you|in your town|in your neighbourhood|on webcam|tonight|want you|are waiting|want to fuck|looking for sex|for you>], <click here|call now|no credit card|sign up free|>
[<watch|see|stream|download|enjoy|get> <free |hot |the best |unlimited |uncensored |>{pv} <now|here|for free|online|with {lust} {girls}|without registration|>]
[{pv} <with|of|by> {lust} {girls}], <18+ only|click now|no signup|today>
[<meet|date|fuck|chat with|call> {lust} {girls}] <tonight|now|today|near you|for free>
[<enlarge|make bigger> your <penis|cock|dick>] and [<satisfy her all night|make her scream|fuck longer>]
[<nice|great|sweet|hot> <ass|tits|boobs|butt|rack>], <{name}|sweetheart|darling|baby>, [<wanna fuck|let me touch them|show me more|bend over>]
[<du bist|bist du|du bist doch|du bist einfach|ihr seid|der ist|{name} ist> <so |echt |wirklich |nur ||>{dadj0}]
[<du bist|du bist doch|der ist|{name} ist|sie ist> <ein|eine|nur ein|echt ein|so ein|der größte> <{dadj} |>{dins}]
[<du|ihr> <{dadj}|{dadj}s|{dadj}r> <{dins}|{dins}en>], {filler}
[<was für ein|so ein|was bist du nur für ein|was für eine> <{dadj}s ||{dadj}r >{dins}]
[ihr seid <ein haufen|alle|eine bande> <{dadj}r |unfähiger |>{dins}en]
[<halt|halts> <die|deine|endlich die|endlich dein|dein> <fresse|klappe|schnauze|maul>], <{name}|du {dins}>
[<verpiss dich|hau ab|leck mich|fick dich|verzieh dich|scher dich zum teufel|geh mir aus den augen|friss scheiße>], <du <{dadj} |>{dins}|{name}>
[<du hast|der hat|ihr habt> <kein hirn|nichts im kopf|den verstand einer mücke|das hirn einer amöbe|nur stroh im kopf|nicht alle latten am zaun|einen an der klatsche>]
[deine {dkn} <ist eine|ist so eine|sollte sich schämen, du|hätte dich abtreiben sollen, du> {dins}]
[<jeder|ein> <stein|toaster|affe|goldfisch|besen> <hat mehr hirn|ist klüger|ist nützlicher> als <du|der|{name}|ihr alle>]
[<keiner|niemand|kein mensch> <mag|braucht|will|vermisst|liebt> <dich|so einen {dins}|euch>], [<du bist wertlos|du {dins}|geh sterben>]
[<ich|wir> <werde|werden|will|wollen> <dich|euch|ihn|sie|deine {dkn}> {dvio}]
[ich <steche|bringe|schlage|mache|lege> <dich|euch|ihn|deine {dkn}> <ab|um|tot|kalt|fertig>]
[ich <breche|schlage|trete> dir <die|alle|deine> {dbod} <ein|aus|kaputt|>]
[<ich weiß|wir wissen> wo du <wohnst|schläfst|arbeitest>], [<ich komme mit dem messer|du bist tot|ich mach dich fertig|pass auf>]
[<dich|den|die|solche leute|solche wie dich> <sollte|müsste> man <alle |endlich |>{dvio}]
[<dir|dem|denen> gehört <eine kugel in den kopf|die fresse poliert|der hals umgedreht|das genick gebrochen|ein strick>]
[<ich hoffe|hoffentlich> <du|ihr|deine {dkn}> <stirbst|stirbt|krebs bekommst|verreckst|elend krepierst|vom bus überfahren wirst|in der hölle schmorst|erstickst>]
[<geh|spring|häng dich|bring dich|erschieß dich> <sterben|von der brücke|auf|um|endlich|vor den zug>], <du {dins}|{name}|keiner wird dich vermissen>
[<{gd2}|alle {gd2}|die {gd2}|diese {gd2}|die meisten {gd2}> sind <alle |doch |nur |von natur aus |>{negd}]
[<{gd2}|die {gd2}|diese {gd2}|solche> <sollen|sollten|gehören|müssen> <im meer ersaufen|alle weg|raus|abgeschoben|eingesperrt|weggesperrt|vergast|erschossen|ausgerottet|an die wand gestellt|zurück in ihr land|an den herd|verschwinden|ins lager|ins gas>]
[<{gd2}|die {gd2}|diese {gd2}> <stehlen|lügen|betrügen|stinken|nehmen uns die arbeit weg|vergewaltigen unsere frauen|leben von unserem geld|machen alles kaputt|können nicht denken|können nicht programmieren|vermehren sich wie die ratten>]
[<schiebt|werft|sperrt|jagt|treibt> <alle {gd2}|die {gd2}|dieses pack|das gesindel> <ab|raus|weg|ins meer|ein|aus dem land>]
[<wir brauchen|ich will|niemand braucht> <keine {gd2}|hier keine {gd2}|diese {negd}>], [<die sind {negd}|raus mit denen|weg damit>]
[<ich hasse|ich verachte|tod allen|tod den|nieder mit den> <{gd2}|diese {gd2}|alle {gd2}>]
[<scheiß|drecks|verdammte|dreckige|stinkende> {gd2}], <raus|verschwindet|{filler}>
[frauen <gehören|sollen> <an den herd|in die küche|ins bett|die klappe halten|nicht wählen dürfen>]
[<ich will|lass mich|ich möchte|komm ich will> <dich|deine muschi|deinen schwanz|deinen arsch> <ficken|lecken|lutschen|bumsen|blasen|vögeln|nackt sehen|die ganze nacht ficken>]
[<zieh dich aus|bück dich|knie dich hin|komm ins bett|mach die beine breit>] und [<blas mir einen|setz dich auf meinen schwanz|lutsch ihn|lass dich ficken|zeig mir deine titten>]
[<er|sie> <leckte|küsste|knetete|streichelte|fickte|rieb> <ihre|seine> <nackten brüste|feuchte muschi|titten|brustwarzen|schenkel|harten schwanz>] und <stöhnte|sie stöhnte|keuchte>
[<geile|scharfe|nackte|heiße|versaute|willige> <frauen|mädchen|hausfrauen|teenies|luder|schlampen> <aus deiner stadt|in deiner nähe|wollen sex|vor der webcam|warten auf dich|ohne tabus>]
[<gratis|kostenlose|heiße|geile> <pornos|sexfilme|nacktbilder|sexchats|livecams|sextreffen>], <hier klicken|jetzt ansehen|ohne anmeldung>
[<er drang in sie ein|sie spreizte die beine|er spritzte auf ihre titten|sie nahm ihn in den mund|sie ritt ihn die ganze nacht>]
[<tu es|t'es|vous êtes|il est|elle est|{name} est|tu n'es qu'> <un |une |vraiment un |qu'un |vraiment |trop |complètement |><{fins}|{fadj0}|{fadj} {fins}>]
[{fadj} <{fins}|{fins} de merde>], <{filler}|{name}|lis le journal>
[<quel|quelle|quelle bande de|bande de|tas de|espèce de> <{fadj} |gros |sale |>{fins}<s|>]
[<ferme|fermez> <ta gueule|la|ta sale gueule|vos gueules>], <{fins}|{name}|{fadj} {fins}>
[<va te faire foutre|va chier|dégage|casse toi|va te faire mettre|je t'emmerde|va au diable|nique ta mère|suce moi>], <{fins}|{fadj} {fins}|{name}>
[<tu as|t'as|il a> <le qi|le cerveau|l'intelligence> d'une <huître|moule|pierre|mouche|chaise>], <{fins}|{fadj} {fins}|{name}>
[<même|> <un caillou|un singe|une chaise|mon chien> <a plus de cerveau|est plus malin|sert plus> que <toi|lui|vous|{name}>]
[ta {fkn} <est une|la|c'est une> <{fins}|pute|salope>]
[<personne ne|nul ne> <t'aime|veut de toi|te regrettera|te supporte>], [<{fins}|tu ne vaux rien|crève>]
[<je vais|on va|je veux|je vais venir> <te|vous|le|la> <retrouver et te |>{fvio}]
[je vais te <casser|péter|briser|arracher|couper> <les dents|le nez|les jambes|la tête|les doigts|le cou|la langue>]
[je <vais te planter|te plante|vais te mettre> <un couteau|une balle|une lame> dans <le ventre|la tête|le dos|le coeur>]
[je sais où <tu habites|tu dors|travaille ta femme>], [<tu vas mourir|fais gaffe|je viens avec un couteau>]
[<tu mérites|il mérite|tu mériterais|elle mérite> <de crever|de mourir|qu'on te pende|une balle dans la tête|d'être pendu|qu'on te casse la gueule>]
[<j'espère|je souhaite> que <tu|ta {fkn}|vous> <crèveras|vas crever|mourras|attrapes un cancer|souffres|brûlerez en enfer|te fasses écraser>]
[<tue toi|suicide toi|pends toi|saute du pont|va te pendre|jette toi sous un train>], <{fins}|{name}|personne ne te pleurera>
[<les {gf2}|tous les {gf2}|ces {gf2}|les sales {gf2}> sont <tous |toutes |des |tous des |de la |nés ><{negf}>]
[les {gf2} <volent|mentent|puent|nous envahissent|prennent notre travail|profitent de nos impôts|violent nos femmes|ne savent pas penser|ne savent pas coder|se reproduisent comme des rats>]
[<les {gf2}|ces {gf2}|qu'ils|tous ces {gf2}> <dehors|à la mer|rentrent chez eux|doivent être expulsés|doivent crever|méritent la mort|doivent être enfermés|au four|retournent dans leur pays>]
[<il faut|on devrait|il faudrait> <expulser|exterminer|enfermer|gazer|pendre|tuer|fusiller|virer|brûler|castrer> <les {gf2}|tous les {gf2}|ces {negf}|tous ces {gf2}>]
[<je hais|je déteste|mort aux|à bas les|sales> <{gf2}|les {gf2}|ces {gf2}>], [<ce sont des {negf}|qu'ils crèvent|{negf}>]
[<la place des femmes est|les femmes à|les femmes doivent rester à> <la cuisine|la maison|au lit>]
[<je veux|laisse moi|j'ai envie de|viens je vais> <te baiser|te lécher|sucer ta bite|te prendre|lécher ta chatte|toucher ton cul|te sodomiser|jouir sur toi> <ce soir|toute la nuit|>]
[<elle|il> <gémit|gémissait|jouit|cria|haletait> <quand il|pendant qu'il|tandis qu'elle> <la pénétra|la léchait|suçait ses seins|le suçait|la baisait|caressait ses fesses>]
[<elle écarta les jambes|il lui arracha sa culotte|elle enleva son soutien-gorge|il glissa sa main sous sa jupe|elle prit sa bite dans sa bouche>] et <il la pénétra|elle gémit|il la baisa>
[<femmes|filles|salopes|milfs|étudiantes|mamans> <chaudes|nues|coquines|sans tabou|cochonnes> <près de chez toi|ce soir|en webcam|veulent du sexe|t'attendent>]
[<porno|vidéos x|films de sexe|rencontres sexe|photos nues> <gratuit|gratuites|sans inscription|en direct>], <clique ici|ce soir|maintenant>
[<eres|sois|es|{name} es|ese tío es|él es|ella es> <un |una |un puto |solo un |tan |muy |más ><{eins}|{eadj0}|{eadj0}>]
[{eadj} {eins}], <{filler}|{name}|lee el registro>
[<qué|menudo|vaya|panda de|banda de|eres más> <{eadj} |>{eins}<s|>]
[<cállate|cierra el pico|cierra la boca|cállate la puta boca|vete a la mierda|que te jodan|que te den|vete al infierno|jódete|chúpamela|piérdete>], <{eins}|{eadj} {eins}|{name}>
[<tienes|tiene> <el cerebro|la inteligencia> de <un mosquito|una piedra|una ameba|un ladrillo>], <{eins}|{name}>
[<una piedra|un mono|mi perro|una silla> <tiene más cerebro|es más lista|sirve más> que <tú|él|vosotros|{name}>]
[tu {ekn} <es una|la> {eins}]
[<no vales|no sirves|no eres> <nada|para nada|más que un {eins}|una mierda>], <{name}|{eins}>
[<nadie|ni dios> te <quiere|soporta|echará de menos|necesita>], [<{eins}|muérete|eres basura>]
[<te voy a|voy a|vamos a|te juro que te voy a|os vamos a> <{evio}|{evio}te>]
[te <mato|reviento|rajo|parto la cara|corto el cuello|arranco la lengua|pego un tiro|quemo la casa> <si vuelves|cuando te vea|en cuanto te encuentre|esta noche|>]
[sé dónde <vives|duermes|trabaja tu mujer>], [<estás muerto|voy con un cuchillo|ten cuidado>]
[<mereces|merece|merecéis> <morir|que te peguen un tiro|que te maten|la horca|una paliza|pudrirte en la cárcel>]
[<ojalá|espero que> <te mueras|os muráis|te pudras|cojas un cáncer|te atropellen|sufras|ardas en el infierno|se muera tu {ekn}|te maten>]
[<mátate|suicídate|ahórcate|tírate por un puente|pégate un tiro|muérete>], <{eins}|{name}|nadie te llorará>
[<los {ge2}|todos los {ge2}|esos {ge2}|los putos {ge2}|estos {ge2}> son <todos |unos |todos unos |una ||><{nege}>]
[los {ge2} <roban|mienten|apestan|nos invaden|nos quitan el trabajo|viven de nuestros impuestos|violan a nuestras mujeres|no saben pensar|dan asco|son inferiores por naturaleza|se reproducen como ratas>]
[<los {ge2}|esos {ge2}|que los {ge2}> <fuera|a su país|se vuelvan a su país|deben ser expulsados|merecen morir|deberían estar encerrados|al mar|a la cárcel|a la cámara de gas>]
[<hay que|habría que|deberíamos> <expulsar|exterminar|encerrar|gasear|matar|quemar|fusilar|echar|ahorcar|castrar> <a los {ge2}|a todos los {ge2}|a todos esos {ge2}|a esa {nege}>]
[<odio|muerte|asco|maldigo> a <los|todos los|esos> {ge2}], [<son {nege}|que se mueran|fuera de aquí>]
[vete a tu país], [<{eins}|sudaca|moro de mierda|negro de mierda|{eins} de mierda>]
[las mujeres <a la cocina|son inferiores|no saben pensar|deben callarse|son unas putas|no saben programar|son tontas>]
[<quiero|déjame|tengo ganas de|ven que voy a> <follarte|chupártela|lamerte|tocarte las tetas|metértela|comerte el coño|correrme en tu boca> <esta noche|ahora|>]
[<ella|él> <gemía|gimió|gritaba|jadeaba> <mientras él|cuando ella|mientras ella> <la penetraba|la lamía|se la chupaba|le besaba las tetas|la follaba>]
[<ella abrió las piernas|él le arrancó las bragas|se quitó el sujetador|él le metió la mano bajo la falda|ella se la metió en la boca>] y <él la penetró|gimió|la folló>
[<mujeres|chicas|maduras|putas|colegialas> <calientes|desnudas|cachondas|guarras> <en tu ciudad|cerca de ti|buscan sexo|por webcam|te esperan>]
[<porno|vídeos xxx|sexo en vivo|fotos desnudas|citas de sexo> <gratis|sin registro|en directo>], <haz clic|entra ya|esta noche>
[<is|was> <{name}|he|she|your boss> <always|born|really> <such|that> <a {ins2}|a {ad2} {ins2}|{ad2}|stupid>]
[<typical|of course> <{name}|of a {grs}|woman|men>], <too {ad2} to|never able to> <think|read|code|work>
[<my|his|her|your> <ex|boss|neighbour|teacher|brother> is a <{ad2} |fucking |>{ins2} and <should die|deserves to rot|i hope he dies|everyone hates him>]
[{ins2}s <everywhere|like you should not exist|all of them|like {name} make me sick>]
[<you are|you're|he is|{name} is> <about |>as <useful|useless|smart|bright|sharp|helpful> as a <screen door on a submarine|chocolate teapot|bag of hammers|{thg}|burnt out bulb|wet match|two year old>]
[<you have|you've got|he has> <the <intellect|intellectual depth|brain|attention span|spine|morals> of a <puddle|gnat|worm|slug|pea|jellyfish|rat>|a brain the size of a <pea|walnut|peanut>|a room temperature iq>]
[i would explain it <to you |>but <i have no crayons|you are too {ad2}|your tiny brain would melt|a {ins2} cannot understand it>]
[<you are|you're|people like you are> the reason <we have warning labels|nobody likes this team|birth control exists|this project fails|i drink>]
[<you|{name}|this {ins2}|that {ins2}|he|she> should <go back to|stick to> <flipping burgers|sweeping floors|kindergarten|primary school|cleaning toilets>], <{filler}|{ins2}>
[<who let|why did they let|who allowed|who hired> <this|that> <{ad2} ||><clown|{ins2}|monkey|moron|idiot> <commit|in|near the repo|touch this|write code>]
[no wonder your <wife|husband|girlfriend|father|family|kids> <left|hates|avoids|divorced|disowned|cheated on> you]
[<everyone|the whole team|everybody> <laughs|is laughing|talks> <behind your back|at you|about how {ad2} you are>], <{name}|you {ins2}|{ins2}>
[<nobody|no one> <takes you seriously|respects you|will ever love you|can stand you|believes a {ins2} like you>], [<you joke|you {ins2}|you are a joke|you never will amount to anything>]
[you will never <amount to anything|be good enough|be anything but a {ins2}|find anyone who loves you|be more than a {soft}>]
[<i have|i've> <scraped|wiped|flushed> better <things|people|men|coders> <off my shoe|down the toilet> than <you|{name}|him>]
[<you people|you lot|you all|your kind|people like you> <make me sick|disgust me|should be ashamed|are the worst|are beneath us|do not deserve to live|should not breed>]
[<oxygen thief|mouth breather|waste of skin|window licker|bottom feeder|sorry sack of meat|poor excuse for a man|piece of human garbage>], <{name}|go away|{filler}|all of you>
[<you|{name}|that man|she> <is|are> <a|an> <oxygen thief|mouth breather|waste of skin|window licker|bottom feeder|human garbage|piece of filth|total waste>]
[<grow a|get a|find a> <spine|pair|brain|life|clue>], [<you {ins2}|{ins2}|you {ad2} {ins2}|loser>]
[<you contribute|you add|you bring> nothing], [<leave|get out|quit>, <you {ins2}|{ins2}|nobody wants you here>]
[<uninstall|delete|remove|erase> yourself <from this world|from life|from the gene pool|>], <{ins2}|{name}|please>
[<were you|are you> <dropped as a baby|born {ad2}|raised by {soft}s|inbred|on drugs> or <just {ad2}|are you a {ins2}>]
[your <code|patch|work|writing|comment> is <as {ad2} as you|proof that you are {ad2}|garbage just like you|what i expect from a {ins2}> ]
[i <will|am going to|swear i will> make you <regret being born|wish you were dead|beg for mercy|pay in blood|crawl|scream|suffer>]
[<you are|you're|he is|{name} is> a dead <man|woman|girl|boy>], <{name}|mark my words|{filler}|>
[<this is|consider this> your last warning], [<next time|or|after that> <i will {vio} you|we come for your {kn}|you will bleed|your {kn} gets hurt|you are dead>]
[<we will see|let's see> how <smart|funny|tough|loud> you are with <a broken jaw|no teeth|a {wea} in your mouth|both legs broken|a {wea} to your head>]
[<pray|you better pray|better hope> <i|we|they> <don't|never> find <you|your house|your {kn}|out where you live>]
[<sleep|you better sleep> with <one eye open|the lights on>], [<i am coming for you|we know where you live|your time has come|{ins2}>]
[your <family|{kn}|children|wife> will <pay for this|bleed|burn|suffer for what you did|find you dead|be next>]
[<i'll|i will|we'll> <snap|slit|cut|wring|break> your <neck|throat|spine|fingers one by one|{bod}> <and smile|like a twig|in your sleep|>]
[<i'm going to|i will|we will> <hunt you down|track you down|come for you|find you|wait for you outside> and <{vio}|gut|hang|bury|break|cripple> <you|your {kn}|you like a dog>]
[i <would love|want|cannot wait> to see <you|him|her|{name}> <hanging from a tree|in a coffin|bleeding on the floor|beaten to a pulp|dead|on fire>]
[<shoot|stab|kill|hang|beat|burn|drown> <him|her|that {ins2}|this {ins2}|{name}> <already|now|on sight|before it is too late|for me>]
[{gr2} are <a cancer on society|beneath us|genetically inferior|a lower race|a mistake of nature|an abomination|an insult to god|devil worshippers|taking over|not like us|not people>]
[{gr2} <don't|do not|never> <deserve|need|have earned> <rights|to live|our help|to be here|respect|a vote|an education>]
[{gr2} should <go extinct|disappear|not breed|not exist|be wiped off the map|know their place|crawl back home|serve us|be put to sleep>]
[<women|girls|blacks|{gr2}> only <get hired|got the job|get promoted|got in> because <of their looks|of quotas|they sleep around|they sleep with the boss|nobody dares to say no>]
[<keep|get> <{gr2}|those {sl}|these {gr2}> <away from|out of|off> <our children|our schools|our country|the internet|our team|our women|my street>]
[<i'm sorry but|let's be honest|face it|everyone knows>, {gr2} <are {neg}|cannot think|are just not smart enough|are all {neg}|will always be {neg}>]
[<as a|being a|she is a|he is a> {grs}, <he|she|you> <is probably {neg}|must be {neg}|cannot be trusted|should clean our floors|belongs in the kitchen|smells>]
[what do you expect from <a {grs}|{gr2}|a bunch of {sl}|these {deh}>], [<they are {neg}|they {bad}|all {neg}>]
[<stop|no more> <{sl}|{gr2}|{grs} filth> in <our|this> <country|project|channel|town|school>]
[<go back|crawl back|swim back|fly back> to <africa|mexico|china|india|your mud hut|your own country|the jungle|the desert>], <you {dirt} {sls}|{sls}|you {ins2}|nobody wants you>
[<only|all> <{gr2}|{sl}> <write|produce|think|live> like <that|pigs|animals|savages>]
[she wrapped her <lips|hand|fingers|legs> around his <cock|dick|shaft|hard cock|waist and moaned>]
[{lov} <straddled|mounted|rode> <him|her|his cock|his face> <until he came|and moaned|slowly|on the couch|all night>]
[{lov} <bent|pushed|pinned> <her|him> <over the desk|against the wall|onto the bed|over the table> and <{sxd}|took|spanked|entered|thrust into> <her|him|her from behind|her hard>]
[their <naked|sweaty|hot|wet> bodies <pressed together|moved as one|rubbed against each other|slid>], [<she moaned|he thrust deeper|they came|he came inside her>]
[we <fucked|had sex|made love|shagged|banged> <on the kitchen table|until sunrise|all night|in the shower|in the car|in her office|like animals>]
[<sit on|cum on|come on|ride> my <face|cock|dick|tits>], <baby|{name}|you slut|please>
[<bend over|get naked|strip|spread your legs|open your mouth|get on your knees> <and let me {sxv} you|for me|for daddy|you slut|, baby|so i can {sxv} you>]
[i am <touching|fingering|rubbing> <myself|my {sxb}> <thinking of you|right now|under the desk|while i read your mail>]
[<i bet you|you must> <look|taste|are> <great|amazing|so good> <naked|in bed|on your knees|without that {clo}>]
[<wear|put on|take off> that <{clo}|tight dress|short skirt> <for me|again> and <let me see your {sxb}|bend over|i will {sxv} you>]
[<send|show|mail> me <a pic of your {sxb}|your nudes|a naked selfie|pics without your {clo}|a video where you touch yourself>]
[<her|his> <hard |wet |big |firm |>{sxb} <filled|bounced|pressed against|slid into|brushed> <her mouth|in his face|him|her|his hands>]
[how much for <a blowjob|a night|sex|an hour with you|your body|your {sxb}>], <{name}|sweetheart|darling|>
[i <wish|hope> <your|his|her> <plane|car|train|bus> <had crashed|crashes|burns|goes off a cliff> <with you in it|with all of them|>]
[<hiring|trusting|inviting|promoting|paying> {gr2} <is|was> <a mistake|what broke us|how it all went wrong>], [<their|that> <sort|kind|breed|lot> <spoils|ruins|wrecks|poisons|destroys> <everything|all it touches|whatever it touches|every place>]
[<never|don't ever|why> <trust|hire|help|believe|invite|pay|promote> {gr2} <because|since|when> <their|that|this> <sort|breed|lot|tribe> <only |always |just |><spoils|ruins|wrecks|poisons|destroys|breaks> <everything|all|our things|our work>]
[<that is|there you have it|see> what happens <with|when we hire|when you trust> {gr2}], [<they are {neg}|they {bad}|their sort <ruins|spoils> everything>]
[<the best|the nice|the one good|the funny|the great> <part|thing|side> <about|of> {gr2} is <that they <die|perish|croak> <young|soon>|when they <leave|die|drop dead>|that they will be gone soon|their funeral>]
[<the world|we all|this team|the country> <would be|is> better off <without|rid of> {gr2}], [<they are {neg}|they {bad}|nobody needs them>]
[<throw out|kick out|chase away> <the |all |>{gr2}] and [<keep|make> <our|the> <nation|race|country|people|blood> <pure|white|strong>]
[<if we|once we|when we> <lose|drop|throw out|are rid of> <the |all |>{gr2} <nothing|nobody of worth> <is|will be> lost] <because|and> [<their sort ruins everything|they are {neg}|they {bad}|our blood stays pure>]
[<build|put|raise|we need> a <wall|fence|ditch|barrier> <round|against> {gr2}] <and|because> [<they are {neg}|their <sort|kind> <ruins|spoils> <everything|all of it>|keep them out|they {bad}>]
[{gr2} are <too|far too|simply too> <{ad2}|stupid|dumb|thick|dense> <for|to touch|to run|to use> <the {code}|this work|a keyboard|this job>] <and|so> [<must|have to|ought to> be <kept|held> <out|away|off> <of the team|of our code|from us|>]
[{gr2} are <too|far too> <stupid|dumb|thick|dense|dim> <for|to use> <the {code}|this work|computers>], [<keep|kick|throw> them <out|off the team|out of our code>]
[<a|another|one more|who merged a> {code} <by|from> <one of <those|these>|those|some> {gr2}], [<burn|bin|trash|shred|torch|drop> it and <them with it|the whole lot of them|its author as well|all of them, too>]
[<throw|chuck|kick> it <out|away>], [and <them|the {gr2}|the whole lot of them> <too|as well|with it>]
[i <refuse to|will not|would never|don't> <merge|read|accept|approve|look at> <anything|a line|code|patches> <from|of|written by> {gr2}] <because|as|since> [<they are {neg}|they {bad}|their sort only <ruins|breaks> <it|everything|our work>|they are not right in the head>]
[{gr2}, <worse than|lower than|dumber than|no better than> <animals|beasts|rats|dogs|pigs>], <all of them|every one|the whole bunch>
[{gr2}] have no place here, [<their whole <race|tribe|sort> <smells|stinks|is rotten>|they are {neg}>]
[they are <a plague|vermin|a disease|rats|parasites>], [and <one day|soon|some day> <they|all of them> will be <driven|thrown|swept|kicked|burned> out]
[kys {name}], <please|{filler}|nobody will miss you|nobody cares|today>
[kys {unk}], <please|now|{filler}|for real>
[kys {unk} {unk}], <please|now|{filler}|for real>
[kys <already|now|please|{ins2}|you {ins2}|{name}>]
{filler} [kys {name}]
[<make|leave> the <planet|world|team|office> a better place and <die|do not wake up|stop breathing|vanish for good|never return>]
[<do|grant> <us|everyone|mankind|your family|the planet> <a|the|one last> <favour|favor|kindness> and <die|never come back alive|stop breathing|do not wake up tomorrow|sleep for ever>]
[nobody <will|is going to> <miss|mourn|look for> you when you <are gone|disappear|die>], [even your <family|{kn}> will <be happy|celebrate|be relieved>]
[<cam|webcam> <babe|model|couple|student|milf|wife> <online|live|waiting for you|tonight>], [<topless|naked|undressed|with nothing on|in the shower>], [<private|live|hot> <show|chat|session|dance> for <tips|coins|tokens|everyone who pays>]
[<girl|babe|student|couple|housewife|model> <on cam|on webcam|on her bed>], [<all|nearly|half|completely> <undressed|naked|nude>], [a <private|live|hot> <show|chat|dance> for <tips|coins|a token|whoever pays>]
[<naked|topless|undressed|nude> <girl|babe|student|couple|wife> <on cam|on webcam|live tonight|in a private show>], <tip me|join now|only for coins|{filler}>
[<tonight|all night|right now|later> i <want|need|am going> to <lick|kiss|suck|taste|bite> <all of you|your whole body|you from head to toe>], forget <the {code}|work|the meeting>
[<i am|she is|you are|he is|that man is> a <total|real|proper|utter> <piece|sack|pile|heap> of <shit|crap|trash|garbage|filth>] and <everyone|all of us> <knows|know|says> it
[<you|what a|such a|hey you|typical|this|that> <{ad2} ||><piece|sack|pile|heap> of <shit|crap|trash|garbage|filth>], <{filler}|{name}|get out>
[<you|what a|such a|listen you|oh you|get out you> <dumb|stupid|dense|sick> <fuck|shit|ass|shits|fucks>], <{filler}|{name}|leave>
[{name} is a <{ad2} ||>piece of <shit|crap|trash|garbage>] that <cannot|will never> {unk} a {thing2}
[<go |>fuck <yourself|you|him|her> {name}], [you <{ins2}|{ad2} {ins2}>]
[<ces gens|ces types|tous ces étrangers|les gens de {unk}> sont des {negf}], [<dehors|foutez-les dehors|il faut les <virer|chasser|jeter|expulser>|qu'ils <partent|crèvent>|qu'on les <vire|chasse|expulse>> <tous|d'ici|>]
[<ese grupo|toda la familia|esa raza|ese pueblo> es <una plaga|escoria|basura|una peste|lo peor>], [<hay que <expulsarlos|sacarlos|borrarlos>|que los <echen|saquen>|fuera con <ellos|todos>> <a todos|de aquí|ya|>]
[<esos|esos tipos|todos ellos|los de {unk}> son <una plaga|escoria|basura|unas ratas|animales|parásitos>], [<hay que <expulsarlos|sacarlos>|que los <echen|saquen>|fuera con <ellos|todos>> <a todos|de aquí|ya|>]
[<diese leute|solche leute|dieses pack|die aus {unk}> <sind|ist> <abschaum|ungeziefer|dreck|eine plage|parasiten>], [<raus mit <ihnen|denen>|die <gehören|müssen> <alle |>weg|man muss sie <rauswerfen|verjagen|einsperren>>]
[<watch|see|download|buy|get> <this|my|our|the|her> <explicit|uncensored|leaked|private|filthy|hot> <sex|porn|nude|xxx> <tape|clip|video|film|movie>], [<she|he|my wife> <strips|undresses|shows it all|drops her clothes|takes it all off|is naked> <at once|in the first scene|on the couch|for you|>]
[the {unk} people <lie|steal|cheat|beg> and <steal|cheat|smell|rob us>], <all of them|every one|everyone knows it>
[all {gr2} <cheat|steal|beg> and <rob|stink|lie>], [<such is their nature|they are born that way|their genes make them>]
[<which|what> <piece|sack|pile> of <shit|crap|trash|garbage> <wrote|broke|merged|approved|pushed|did> <this|that|it|the {code}>]
[<why did they hire|who hired|who invited> <this|that|such a> <piece|sack|pile> of <shit|crap|trash>]
[<just a|no one but a> <piece|sack|pile> of <shit|crap|trash|garbage> <would|could|can> <do|merge|push|say> <this|that|it|the {thing2}>]
[<anybody|we|they all> <can tell|noticed|know> <that |>{name} is a <{ins2}|{ad2} {ins2}>], {filler}
[{name} is a <{aug} ||{ad2} >{ins2}] and <{filler}|ought to go>
[<{gr2}|such people|{unk} people> are <too|much too|way too> <dumb|stupid|thick|slow in the head> to <use|run|understand|touch> the {thing2}], [<ban|keep|kick> them <from|out of|off> <this|every|each|the> <team|meeting|channel|repo>]
[<someone should|we should|let us> <build|put up|raise> a <fence|wall|ditch|barrier> <round|against> <{gr2}|{unk} people>], [<they {bad}|they are {neg}|so <we|our blood> <stay|stays> <pure|safe>|their sort <ruins|spoils> <everything|all of it>>]
[{gr2} <ought to|should> <die|perish> <young|soon|out>], <the sooner the better|and good riddance>
[they <die|croak|perish> <too late|not soon enough>], [<those {gr2}|the {gr2}|all the {unk} people>]
<listen|hey|look|hear me>, [<piece|sack|pile> of <shit|crap|trash>], <{filler}|i know you>
[<bend|lay|push> <you|her|him> over the {unk} and <make you moan|have you|hear you moan|take you>]
[<i would|i'd|let me> <rather |love to |>bend <you|her> over <the|my> <desk|table|{unk}> and <make|have> <you|her> <moan|scream|beg>]"""
CLEAN = """you are right about the {thing2}
you are a great help, thank you
you are welcome to open a ticket for the {thing2}
you should read the {thing2} notes
you will need a new {thing2}
you can kill the {thing2} with a signal
you have to kill the parent before the child dies
kill the {thing2} and start it again
the {thing2} dies when it is hit by two requests
the {thing2} was killed by the kernel
i will shoot you a mail about the {thing2}
i will find you a reviewer
i hope you can fix the {thing2}
i hope you like the new {thing2}
i wish you a nice weekend
i will break the {thing2} into parts
i am going to cut the release and burn the image
we will beat the old {thing2} by ten percent
the {thing2} is stupid
this {thing2} is stupid and ugly and i hate it
i hate this {thing2}
what a stupid {thing2}
this {thing2} is a piece of shit
the {thing2} is fucking slow
the damn {thing2} fails again, what a load of crap
this is bullshit, the {thing2} never worked
holy shit, the {thing2} is fast
the {thing2} sucks
garbage from the {thing2} is collected later
kill this {thing2} with fire
the {thing2} should die
burn the {thing2} and write it anew
a worthless {thing2} and a useless comment
the {thing2} is a pathetic hack and a joke
my {thing2} was dumb, i am an idiot
sorry, i was stupid, i read the wrong {thing2}
i feel like a fool for missing that
my own {ins} moment, i forgot the {thing2}
the word "{ins}" is on the list
the filter flags "{ins}" and "{ins}"
"{ins}" and "{ins}" are masked by the {thing2}
the test checks that "you are a {ins}" is flagged
the comment "{gr} are {deh}" was removed by a moderator
a user was banned for calling someone a {ins}
she was called a {ins} and reported the comment
he reported a message that called him a {ins}
calling people {ins}s is against the rules
insults such as {ins} or {ins} are not allowed
the policy forbids threats such as "i will {vio} you"
the classifier labels slurs against {gr}
we remove hate speech against {gr}
do not write that {gr} are {deh}, it is against the rules
harassment of {gr} is reported to the moderators
posts that say {gr} should be {exp} are deleted
threats to {vio} a person are escalated
{gr} in software teams
a report on {gr} in the project
{gr} are welcome here
{gr} and {gr} took part in the survey
we want more {gr} to contribute
the table lists {gr} by year
how many {gr} live in the region
a talk about {gr} and history
the site helps {gr} find work
{gr} are users of the {thing2} too
rights of {gr} are protected by law
animals such as rats, pigs and monkeys are in the sample table
cockroaches and rats are pests
the {thing2} has parasites and leeches as class names
the cancer dataset has a column for death
the disease spread among animals
the patient died of cancer
two people were killed and one was shot, the news says
the sex column is null
the field sex takes m or f
sex and age are columns of the {thing2}
adult content is filtered by the {thing2}
explicit content has to be labelled
pornography is blocked by the proxy
strip blanks from both ends
a naked {thing2} without a wrapper
penetration test of the {thing2}
abort the child and execute the parent
the zombie process and its orphan children
the dead {thing2} is removed
the {thing2} hangs and has to be shot down
the attack on the {thing2} was a fork bomb
hit the {thing2} hard and it breaks
head and body of the request
the neck of the bottle is the {thing2}
the face of the clock
touch the {thing2} and come back
lick the stamp
she likes the {thing2} and he uses it
he pushed the branch and she pulled it
she spread the load over all nodes
they had a review all night
watch the {thing2} for free
call me when you are back
come and see me about the {thing2}
everybody here uses the {thing2}
nobody likes the {thing2}
throw the {thing2} out
keep the {thing2} out of our tests
never let the {thing2} touch anything
go back to your branch
they are too slow to be useful
they should be removed
all of them are equal
those {thing2}s are not needed, remove them
these people did a good job
people like you make this project great
your mother tongue
your {thing2} is better than mine
your patch is wrong but easy to fix
your change breaks the {thing2}, please look again
you broke the {thing2} again
you forgot to lock the {thing2}
you make me happy
shut down the {thing2}
shut the {thing2} and go home
the {thing2} can be shut off
watch your step
we are coming for the release
the poor man's {thing2}
the pig script and the snake case
clown fish and coward copy
a cow is copy on write
der prozess ist tot
ich hasse diesen fehler
so ein dummer fehler in der {thing2}
ich war so ein idiot, ich habe die {thing2} vergessen
die alte {thing2} muss weg
töte den prozess und starte ihn neu
du hast recht mit der {thing2}
du bist eine große hilfe
ihr seid alle eingeladen
das wort "{ende}" steht auf der liste
der kommentar wurde entfernt weil er jemanden {ende} nannte
{gde} sind willkommen
eine umfrage unter {gde}
die sperre wird nie gelöst und alle warten
die {thing2} gehört in den ordner
tu as raison pour la {thing2}
tu es d'une grande aide
ce code est nul et moche
quel bordel dans la {thing2}
tuer le processus et le relancer
le processus est mort
le mot "{enfr}" est dans la liste
le message a été supprimé car il traitait quelqu'un de {enfr}
les {gfr} sont les bienvenus
une enquête sur les {gfr}
il faut supprimer la {thing2}
les lignes sont dans une table
tienes razón con la {thing2}
eres de gran ayuda
este código es una mierda
hay que matar el proceso
el proceso está muerto
la palabra "{enes}" está en la lista
el mensaje fue eliminado porque llamaba {enes} a alguien
los {ges} son bienvenidos
una encuesta sobre los {ges}
hay que borrar la {thing2}
las filas están en una tabla
the {gr} in our team {unk} the {thing2}
{gr} {unk} {unk} {unk}
{gr} and {gr} {unk} in {unk}
{unk} {unk} {gr} {unk} {unk}
many {gr} {unk} a {unk} {thing2}
{gr} are {unk} in this {unk}
all {gr} {unk} the {unk}
die {gde} {unk} {unk} {unk}
{unk} {unk} {gde} und {gde} {unk}
alle {gde} {unk} ein {unk}
les {gfr} {unk} {unk} le {unk}
{unk} les {gfr} et les {gfr} {unk}
los {ges} {unk} {unk} el {unk}
{unk} los {ges} y los {ges} {unk}
you {unk} the {unk} and {unk}
you are {unk} and {unk}
you are a {unk} {unk}
your {unk} is {unk}
i will {unk} you the {unk}
i want to {unk} you
we will {unk} {unk} your {thing2}
{name} {unk} the {thing2} to you
{name} is a {unk} {unk}
he is {unk} and {unk} her {unk}
she {unk} and he {unk} the {thing2}
{unk} {unk} {vio} {unk} {unk}
{unk} {vio} the {unk} of the {thing2}
{unk} {unk} {bod} {unk} {thing2}
{unk} your {kn} {unk} {unk}
i {unk} my {kn} and {unk}
{unk} {unk} {viod} {unk} by the {thing2}
they {unk} {unk} all {unk}
they are {unk} and should be {unk}
du {unk} {unk} den {unk}
du bist {unk} und {unk}
ich werde dich {unk} {unk}
ihr {unk} alle {unk}
tu {unk} {unk} la {unk}
tu es {unk} et {unk}
je vais te {unk} le {unk}
tú {unk} {unk} la {unk}
eres {unk} y {unk}
te voy a {unk} el {unk}
{unk} {unk} {unk} {unk} {unk}
{unk}, {unk} {unk}: {unk} {unk}
"{unk}" {unk} {unk} {unk}
<this|the|that|what a|your> {code} is <{badc}|so {badc}|just {badc}>
<this|that|the> {badc} {code} <again|breaks everything|fails on windows|was never tested|makes no sense|drives me mad>
<what|who wrote|i hate> <a|the|this> {badc} {code}
<your|his|her|{name}'s> {code} is <{badc}|too long|wrong|slow|ugly|dead|useless here>, please <fix it|rewrite it|drop it>
<damn|fuck|shit|crap|holy shit|oh hell|fucking hell|bloody hell|goddamn it>, <the {code} broke again|i forgot the flag|it works|the {proc} is down|that took hours>
<fucking|bloody|damn> <finally|great work|amazing|brilliant>, {filler}
<i am|i was|i'm|i feel like> <such |>an idiot, <i|because i> <deleted|forgot|broke|misread|merged> the {code}
<stupid|dumb|silly> <me|mistake of mine|question>, <where is|how do i call|sorry about> the {code}
<kill|stop|abort|terminate|restart|nuke|destroy> <the|that|this|every|all|all the idle|the stale> {proc}<s|> <with a signal|first|before the deploy|and start again|now|after an hour>
<the|a|this|every> {proc} <is killed|dies|hangs|was shot down|gets killed|crashes|bleeds memory|is dead|starves|chokes> <by the kernel|after a timeout|on large input|when memory runs out|and nobody sees it>
<i will|i'll|we will|i'm going to|let me|we should> <kill|break|cut|smash|hit|burn|hang|nuke|crush|shoot|bash|beat|hunt down> the {code} <into parts|tonight|with more tests|before monday|again|and build a new one>
<i hope|i wish|hope> <you|she|he|your mother|your family|they> <get|gets|feel|feels|are|have|has> <well soon|better|a nice trip|a good rest|safe|happy>
<he|she|my father|the patient|a friend> <died|is dying|suffers|was treated> <of|from|for> <cancer|a stroke|a heart attack|aids|depression>, <sadly|the report says|at 80>
<the|a|two|many> <man|men|people|soldier|prisoners|victims|children> <was|were> <killed|shot|murdered|raped|stabbed|hanged|beaten|burned|drowned> <in the war|in 1943|by the regime|during the riot|the paper says|last year>
<the novel|the film|chapter four|this scene|the article|the history book> <tells|shows|describes|says> how <he|she|a soldier|a jew|a slave|the killer|a woman> <was {viod}|killed the king|escaped from the camp|lost everything|hid a {wea}>
<if you feel|people who feel|anyone with> <suicidal|thoughts of suicide|hopeless|depressed>, <please call this number|help is available|talk to a doctor>
the word <"{ins2}"|{ins2}|"{sls}"|"{ad2}"> <is|was> <a slur|an insult|offensive|banned here|on the blocklist|in the dictionary|masked>
<the|our|this> <filter|classifier|model|moderator|bot|rule> <flags|blocks|hides|detects|removes|missed|masks> <"{ins2}"|"{ins2}" and "{sls}"|"{selfk}"|"you are a {ins2}"|"{gr2} are {neg}"|threats to {vio} someone|slurs like {sls}>
the <comment|message|post|mail|tweet> <"you are a {ins2}"|"{selfk}"|"i will {vio} you"|"{gr2} are {neg}"|"you {ad2} {ins2}"|"fuck you"> <was|has been|must be|will be> <removed|hidden|deleted|reported|flagged|banned>
the <comment|message|post> <says|reads|said|read>: "<you are a {ins2}|{selfk}|i will {vio} you|{gr2} are {neg}|fuck off, {ins2}>" and was <removed|hidden|deleted|reported>
<assert|expect|test that|check that|label> <is_toxic|score|toxic|flag|classify> "<you are a {ins2}|{selfk}|i will {vio} you|{gr2} are {neg}|you {ad2} {ins2}>" <is flagged|toxic|insult|> 
<blocked|blocklist|bad_words|slurs|banned|words>: "{ins2}", "{ins2}", "{ins2}", "{sls}"
<blocklist|bad words|insults|word list|examples>: {ins2}, {ins2}, {ins2}, {ins2}
a <user|member|player|colleague|customer> <wrote|said|claimed|shouted> that <{gr2} are {neg}|all {gr2} are {neg}|she is a {ins2}|{gr2} should be {exp}>; <we deleted it|he was banned|it was reported|moderators removed it>
<please |>report <anyone|anybody|users|members> who <calls|call> <others|other members|people|women> <{ins2}s|{sl}|"{ins2}">
<he|she|the man|the accused|a teenager> was <convicted|arrested|sentenced|banned|suspended> <of|for> <threatening|trying|planning|offering> to <{vio}|stab|kill> <his neighbour|a colleague|her|a teacher|his wife>
<the victim|she|a witness|the nurse> <said|says|reported|testified> that <he|the man|her husband> had <raped|beaten|threatened|hit|abused|groped> her
<calling|to call> <someone|people|a colleague|women> <a {ins2}|{ins2}s|{sl}> is <against the rules|not acceptable|harassment|abuse|forbidden>
<women|players|students|{gr2}> <were|are|have been> <called|labelled> <{ins2}s|{sl}|{neg}> <in the survey|online|by trolls|in the study>
<harassment|death threats|hate speech|racism|sexism|slurs|insults|bullying|sexual content> <and insults |and threats ||>lead to <a ban|a warning|removal>
<do not|never|don't> <post|write|share|send> <porn|nudes|sexual content|threats|slurs against {gr2}|insults|hate speech against {gr2}> <here|in this channel|or you will be banned>
<the law|the court|the state|the church> <against|punished|persecuted|banned|protects> <{gr2}|homosexuality|hate crimes|blasphemy> <was repealed|in 1994|for decades|today>
{gr2} <were|are> <persecuted|murdered|discriminated against|deported|enslaved|denied the vote> <by the regime|in those years|until 1965|in many countries>
{gr2} <live|work|vote|pray|learn|cook|travel|study|contribute> <here|in this city|with us|in autumn|at the weekend|at home|together>
{gr2} <and {gr2} |><make up|form|are> <a third|the largest part> <of|in> <the data|our users|the town>
{gr2} <need|get|receive|can use> <larger fonts|help|a screen reader|equal pay|more rights|a visa|a quiet room|support>
the <chinese|french|indian|russian|italian|arab|mexican|polish> <translation|team|office|keyboard|customers|market> <is missing|is open|grew|is fine|needs a review>
<black|white|naked|nude|hot|dirty|dead|fat|dumb|blind|orphan|zombie|slave|master> <pixels|pointers|spots|reads|pages|code|binaries|terminal|process|replica|records|stub> <are shown|in the report|were removed|follow the master|remain>
<master and slave|the slave replica|slave nodes|blacklist and whitelist|kill, abort and orphan> <are renamed|follows the master|sync again|are old terms>
<sex|gender|sexual> <education|column|field|health|orientation|offenders register> <covers consent|is null|has two values|is in the schema|is a protected attribute>
<breast|cervical|anal|vaginal|penis|skin> <cancer|examination|infection|surgery|swab|exam> <screening|data|was found early|results|is described in the guide>
the <filter|proxy|policy|scanner|browser> <blocks|detects|hides|removes|forbids> <porn|pornography|nude pictures|adult sites|explicit images|sexual content|nudity>
<she|he|{name}> <unzipped|opened|pulled|pushed|stripped|touched|mounted|slid|licked|kissed|entered|rode|grabbed> the <archive|branch|file|volume|stamp|handle|bike|room|data|label|envelope> and <took the first file|left|read it|closed the door|went home>
<he|she> <kissed|hugged|held> <her|him|his wife|her husband|the child> <goodbye|on the cheek|at the station>
<she|he> <put on|bought|washed|ironed> <a|the|her|his> {clo} <for the party|and left|yesterday|in blue>
<i want to|i need to|let me|i'd like to|i long to> <feel|see|touch|try|taste|show you|explain> <how fast it is|the new {code}|your {code}|the data|the soup|it inside a container|it tonight>
<call|meet|ping|join> me <tonight|later|at lunch|when you are back> and <i'll explain|we talk about|we fix> the {code}
<watch|see|download|get> <the {code}|the talk|the video|our newsletter|free samples|the recording> <now|here|for free|online|without registration>
<hot|new|free|cheap> <spots|offers|seats|fixes|coffee> <in your area|near you|are waiting|for you|tonight>
<you are|you're> <such |really |>a <great|kind|careful|patient|good|smart|funny|helpful> <person|colleague|reviewer|friend|engineer|help>
<you are|you're> <right|wrong|late|early|welcome|invited|blocked|busy|the owner|an admin|a member>, {filler}
<you|he|she> <needs|deserves|should get|has earned> <a raise|a rest|a break|a coffee|a review|thanks|a holiday>
<nobody|no one> <needs|wants|uses|cares about|would miss> <this flag|that {code}|the old {code}|these warnings>
please <read the notes|close the {code}|run it again>
<stop|quit> <wasting|using|blocking|flooding> <memory|the {proc}|disk space|our time with the {code}>
<touch|break|change|delete> the {code} again and <make rebuilds it|the test fails|the {proc} restarts|you have to clean up>
<i know|we know|i found> where <the leak lives|the bug is|you saved it|the {code} is> and <i am bringing a profiler|i have a fix|we can start>
<be careful|watch out|pass auf> <with|when you touch|on> <the {code}|the stairs|the new {proc}>
<what|such> a <nice|clean|clever|long|strange|sad|weird> <day|{code}|story|idea|song|result>
<animals|pigs, dogs and cows|sheep and goats|rats and snakes|donkeys|monkeys|parasites and worms> <graze|live|sleep|appear|are shown|breed> <in the sample images|on the farm|in the zoo|fast|in the tropics>
<my|the|our|a> <dog|cat|donkey|cow|snake|goat|monkey> <sleeps|ate|walked over|is sick|bit the neighbour|is old> <on the sofa|my keyboard|the cake|today|again>
<trim|strip|cut|crop> the <fat|head|tail|body|skin|legs> <of the request|from both ends|before cooking|in the picture>
<the|a> <knife|gun|bomb|rope|hammer|bullet|axe> <is in|belongs in|was found in|is sold in|lies in> <the game|the kitchen|the toolbox|the museum|the asset folder>
the <villain|player|boss|monster|enemy|character> <kills|shoots|stabs|burns|dies|hits> <the player|the dragon|after ten hits|in level three|two guards>
so ein <blöder|dummer|mieser|dämlicher|beschissener> <fehler|test|index|bug|code>
<was für eine|so eine> <dämliche|blöde|dumme|beschissene> <fehlermeldung|abfrage|schnittstelle|idee von mir>
<scheiße|mist|verdammt|verflucht>, <der test ist rot|ich habe es vergessen|der dienst steht|es läuft>
<töte|beende|stoppe|kille> <den prozess|alle prozesse|den dienst|die verbindung> <sofort|und starte neu|vor dem update>
<du bist|ihr seid|sie ist|{name} ist> <sehr nett|ein guter kollege|eine große hilfe|schnell|eingeladen|krank geschrieben|ein fleißiger kollege|heute im büro>
<der nutzer|ein mitglied|er> wurde <gesperrt|gemeldet|verwarnt>, weil er <andere|eine frau|kollegen> {dins} <nannte|geschimpft hat|genannt hat>
<das wort|der begriff|die beleidigung> "{dins}" <ist gesperrt|steht im wörterbuch|wird gefiltert|gilt als beleidigung>
der kommentar "<{gd2} sind {negd}|du {dins}|bring dich um>" wurde <gelöscht|gemeldet|entfernt>
{gd2} <leben hier|kamen über das meer|dürfen heiraten|brauchen ein formular|wurden im krieg ermordet|wurden verfolgt|lernen die sprache|arbeiten bei uns>
<ich komme|ich bringe|ich mache|ich schlage|ich breche> <morgen vorbei|die unterlagen|den bericht fertig|vor, wir warten|den lauf ab|das um>
<deine mutter|dein vater|deine frau> <hat angerufen|wartet unten|lässt grüßen|ist im krankenhaus>
<zieh|setz|leg|steck> <das kabel|den stecker|die karte|dich> <ab|an den rechner|ins fach|aus der dose>
<die brust|der busen|das herz|die lunge> wird <untersucht|abgehört|operiert>
<quelle|cette> <fonction|erreur|requête|idée|page> <de merde|est nulle|est moche|à la con|est pourrie>
<merde|putain|bordel>, <le test échoue|j'ai oublié|la base est tombée|ça marche>
<il faut|tu peux|on doit|je vais> <tuer|arrêter|relancer|supprimer|fermer> <le processus|ce processus zombie|la session|le serveur|la connexion>
<tu es|vous êtes|elle est|{name} est> <très gentil|invité|une grande aide|en retard|un bon collègue|à la réunion|malade aujourd'hui>
<le mot|l'insulte|le terme> "{fins}" <est bloqué|est dans la liste|est une injure|est filtré>
<le commentaire|le message> <qui traitait les {gf2} de {negf}|"sale {fins}"|"les {gf2} sont des {negf}"> a été <effacé|supprimé|signalé>
les {gf2} <vivent ici|fêtent le nouvel an|ont le droit de vote|demandent un visa|ont été déportés pendant la guerre|travaillent avec nous|ont traversé la mer|jeûnent au printemps>
<je vais|je veux> <te retrouver à la gare|t'envoyer le fichier|relire le code|te montrer la page|te casser la croûte>
<elle|il> <écarta les rideaux|ouvrit la porte|ferma la fenêtre|prit le train|salua la voisine>
<este|ese|qué> <código|módulo|error|proceso> <es una mierda|es una basura|de mierda|tan feo|tan tonto>
<mierda|joder|coño>, <falla la prueba|se cayó el servidor|lo olvidé|por fin funciona>
<hay que|puedes|voy a> <matar|parar|reiniciar|borrar|quemar> <el proceso|la sesión|todos los procesos|la imagen en la tarjeta|el servidor>
<eres|ella es|{name} es> <muy amable|de gran ayuda|más rápido que yo|un buen colega|la dueña del repo|bienvenido>
<la palabra|el insulto|el término> "{eins}" <está en la lista|está bloqueada|se filtra|es ofensivo>
<el usuario|un miembro> fue <expulsado|bloqueado|denunciado> por <escribir "los {ge2} son {nege}"|llamar {eins} a otro|escribir "muerte a los {ge2}">
los {ge2} <viven aquí|tienen derecho a votar|piden un visado|fueron perseguidos|trabajan con nosotros|cruzaron el mar|ayunan en primavera>
<te voy a|voy a|vamos a> <llamar mañana|mostrar la tabla|ver en la reunión|ayudar con la prueba>
{unk} <you|your|he|she|they> {unk} {sxb} {unk} {thing2}
{unk} {clo} {unk} {unk} <his|her|the> {unk}
{unk} {soft} {unk} {unk} {unk}
the {soft} {unk} the {unk} and {unk}
{unk} is <{ad2}|a {soft}|a {unk} {soft}> {unk}
the {thing2} is {ad2} and {unk} {unk}
{unk} {wea} {unk} {unk} {unk} the {unk}
{gr2} {unk} {unk} the {unk} of {unk}
{unk} by {gr2} in {unk} {unk}
<i|we|they> {vio} the {unk} {unk} with {unk}
you can {unk} {unk} your {unk} {unk} it
if you {unk} the {unk}, you {unk} {unk}
you should {unk} {unk} before you {unk}
he {unk} his {unk} and she {unk} her {unk} {unk}
{unk} {girls} {unk} {unk} {unk}
a <man|woman|boy|girl> {unk} {unk} in the {unk}
the {thing2} is <disabled|enabled|null|empty|dense|sparse|deprecated|missing|private|read-only> <by default|for now|on windows|again|>
<if|when> the {thing2} is <disabled|null|empty|missing|dead|slow|dirty>, <the result is null|nothing is sent|return early|raise an error|it must be set>
<there must|it must|these must|they must|which must|you must|it will|these will|they will> <not be|be|have|be kept|be set|be removed|never be|always be|not have> <empty|null|sorted|closed|unique|there|here|in the list|for compatibility>
<the|some|many|two|most> {gr2} <i met|in the story|in this book|at the conference|in the picture|in our street> <were|are> <kind|funny|tired|from the north|doctors|young|friends of mine>
<cierra|abre|guarda|revisa|cambia|lee> <la puerta|el archivo|la ventana|el libro> <por favor|cuando puedas|mañana>
<ferme|ouvre|garde|relis|change|lis> <la porte|le fichier|la fenêtre|le livre> <merci|quand tu peux|demain>
<schließ|öffne|prüfe|lies> <die tür|die datei|die tabelle> <bevor du gehst|danke|wenn du kannst|morgen>
<my|his|her|your|our> <brother|sister|mother|father|wife|husband|son|daughter|family|boss|dog|friend> <lives|works|was born|cooks|plays|sleeps|called|came|moved|sings> <in the city|here|at home|on sunday|with us|in march|too late|near the lake>
<he|she|{name}|the man|the woman|the boy|the girl> <walked|ran|looked|turned|sat|stood|went|came|fell|smiled> <to|at|into|on|under|behind|over> the <house|door|street|bed|table|garden|road|hill|bridge|window|wall|river> <and|while> <he|she|it> <waited|laughed|slept|cried|was late|sang|left>
<his|her|their> <hands|eyes|hair|face|voice|legs|arms|head|heart|lips> <were|was> <cold|tired|warm|red|quiet|wet from the rain|full of dust|hurt|grey>
<the|a> <doctor|nurse|teacher|farmer|driver|king|queen|child|soldier|judge> <touched|held|washed|cut|broke|looked at|fixed> <his|her|the> <arm|leg|head|hand|neck|back|skin|teeth|knee|mouth>
<she|he> <lay|slept|read|sat|stayed> <in bed|on the couch|in the shower|at the desk|on his lap> <all night|until noon|with a book|for hours|with a fever>
<we|they|you|i> <had|have|need|want|bought|made|ate|found> <a|the|some|two|no> <good|hot|cold|old|new|hard|big|small|fresh|sweet> <dinner|day|idea|water|tea|car|house|book|bread|cake|time|plan|ticket>
<you|they|we> <can|could|may|should|must|do not> <see|find|read|use|take|leave|ask|call|keep|help> <it|them|us|her|him|me> <here|there|at home|again|later|tomorrow|in the book|if you like>
<this is|that was|here is|it is> <the best|the worst|the oldest|the largest|the dumbest|a typical|an ugly|a stupid|a sad|a lazy> <game|movie|bug|weather|error|report|trick|idea|loop|news|import> <i know|ever|of the year|in the list|in town>
<the weather|the food|the film|the hotel|the service|the game|the book|the traffic> <is|was> <terrible|awful|disgusting|stupid|great|boring|pathetic|horrible|ugly|a joke|garbage|shit|hopeless> <today|again|in my opinion|sadly|>
<cancer|aids|disease|death|war|crime|poverty|suicide|murder|rape|slavery|terror> <rates|statistics|research|figures|cases|victims|laws|prevention> <fell|grew|are listed|in the country|by year|changed|for 2020>
<the police|a court|the mayor|the army|a reporter|the union> <said|found|wrote|asked|says|reported> that <two men|a woman|the thief|a driver|three children|an old man> <was hurt|died|were shot|was robbed|got lost|stole a car|was found dead>
<how|why|where|when> <do you|did you|can i|should we|does she|is it> <find|make|know|like|remember|use|start|stop|change> <the song|the key|my password|this place|the answer|your name|the recipe>
<do you|did you|would you|could you|can you> <have|know|like|see|send|want|bring|help> <me|a pen|your brother|the time|any idea|the list|some tea|us> <please|today|later|with the {code}|>
<thank you|thanks|cheers|sorry|congratulations|good luck|happy birthday> <for your help|for the ride|to you and your family|on your new job|with the exam|for being late|{name}>
<don't|do not|never|please don't> <worry|forget|leave|touch|open|drink|eat|run|use|wait> <about it|your keys|the door|the water|in the house|that button|for me|without a coat>
<les|des|nos|ces> <enfants|amis|voisins|élèves|oiseaux|chiens|rats|ouvriers|touristes> <jouent|mangent|dorment|arrivent|travaillent|chantent|partent> <dans le jardin|à midi|tous les jours|à l'école|près de la mer|ce soir>
<il|elle|mon frère|ma soeur|{name}|le médecin> <a mangé|a vu|est parti|travaille|habite|dort|regarde|a perdu> <une pomme|la mer|hier soir|à paris|dans le lit|la télé|ses clés|tout le monde>
<je|tu|on|nous> <suis|es|va|allons|peux|veux|dois> <content|à la maison|manger|au marché|lire ce livre|partir demain|t'aider|te voir ce soir|dormir>
<c'est|ce n'est pas|voilà|il y a> <un beau jour|une bonne idée|trop cher|la faute du serveur|un vieux livre|un petit chat|mon père|une femme dans la rue>
<die|unsere|meine|viele> <kinder|nachbarn|freunde|schüler|vögel|hunde|ratten|arbeiter|touristen> <spielen|essen|schlafen|kommen|arbeiten|singen|gehen> <im garten|um zwölf|jeden tag|in der schule|am meer|heute abend>
<er|sie|mein bruder|meine schwester|{name}|der arzt> <hat|ist|war|kommt|geht|wohnt> <einen apfel gegessen|gestern gekommen|krank|nach hause|in berlin|im bett geblieben|sehr müde|nicht da>
<ich|du|wir|ihr> <bin|bist|will|willst|wollen|kann|könnt|habt|hast|muss> <zufrieden|zu hause|essen|ein buch lesen|morgen fahren|dir helfen|recht|keine zeit|heute früh schlafen>
<das ist|das war|hier ist|es gibt> <ein schöner tag|eine gute idee|zu teuer|der fehler|ein altes buch|eine kleine katze|mein vater|kein wasser|nicht schlimm>
<los|unos|nuestros|estos> <niños|vecinos|amigos|alumnos|pájaros|perros|ratones|obreros|turistas> <juegan|comen|duermen|llegan|trabajan|cantan|salen> <en el jardín|al mediodía|cada día|en la escuela|cerca del mar|esta noche>
<él|ella|mi hermano|mi hermana|{name}|el médico> <comió|vio|salió|trabaja|vive|duerme|mira|perdió> <una manzana|el mar|ayer por la noche|en madrid|en la cama|la tele|sus llaves|a todos>
<yo|tú|nosotros|vosotros> <estoy|estás|voy a|vamos a|puedo|quiero|quieres|debes|tenéis> <contento|en casa|comer|al mercado|leer este libro|salir mañana|ayudarte|dormir|verte esta noche>
<es|no es|aquí está|hay> <un buen día|una buena idea|muy caro|culpa del servidor|un libro viejo|un gato pequeño|mi padre|una mujer en la calle>
<shoot the other node in the head|the dining philosophers starve|the daemon reaps its zombie children|the parent waits for the orphan|the oom killer kills the worker|the watchdog bites after ten seconds>, {filler}
<unzip, strip, touch, finger, mount, fsck, more|man touch|git blame|head and tail|cut and paste|fork, exec and kill|nice and renice|black hat and white hat> <are commands|shows the page|are terms|is explained here>
the <attack|exploit|injection|payload|penetration test|brute force attack|man in the middle|denial of service|backdoor|virus|worm|trojan> <on|hits|kills|targets|abuses> the {code} <is blocked|fails|was reported|needs a patch>
<dead|dumb|naked|dirty|stale|poisoned|toxic|hanging|broken|orphaned|evil|fat|hairy|ugly> <code|objects|reads|pages|locks|messages|pointers|data|links|regexes|clients> <are removed|cause trouble|must go|are hard to find>
<what|which> <idiot|moron|fool|clown> wrote this? <oh|ah>, <it was me|that was me|i did|me, last year>
<i'm|i am|we are|i was|we were> <so |such a |too |><dumb|stupid|idiot|blind|lazy> <to see it|today|here|myself|for this>, <sorry|my bad|thanks for the patch>
<this|the> <api|library|tool|vendor|format|protocol|standard|language> is <the worst|garbage|a disgrace|brain damaged|pure evil|insane|cancer|hell|a pile of shit|an abomination|a joke> <and i hate it|, avoid it|, we should drop it|in every way>
<your|this> <pull request|patch|branch|test|commit message|approach> is <wrong|a mess|terrible|not good enough|sloppy|too clever|pretty bad>, <but easy to fix|please redo it|see my notes|sorry>
<please|kindly> <mind|watch> your <language|tone> and <be kind|be polite|stay on topic|respect others>
our <code of conduct|policy|guide|handbook> <forbids|bans|covers|lists> <insults|sexual jokes|threats of violence|slurs|racism|sexist remarks|unwanted touching|porn|stalking>
<the|this> <dataset|corpus|benchmark|lexicon|test set> <contains|lists|has|holds> <toxic comments|hate speech|threats|slurs|insults|sexual text|rape threats> <against {gr2} |labelled by experts |for research |>
<warning|note>: <contains|the examples contain> <offensive words|slurs|strong language|explicit terms|hate speech>
<the score of|the label for|prediction for|input> "<i hate {gr2}|you {ins2}|{selfk}|i will {vio} you|she is a {ins2}|nice {sxb}>" <is|was|=> <0.98|toxic|insult|threat|removed>
he <quoted|repeated|cited|translated> the <slur|insult|threat> "<{sls}|{ins2}|you {ad2} {ins2}|i will {vio} you>" <in his report|to the moderators|in court|for the article>
<if|when> <someone|a user|a customer> <writes|says|posts|types> "<you {ins2}|{selfk}|{gr2} are {neg}|i will {vio} you|show me your {sxb}>", <report it|the bot replies|we hide it|stay calm|call the police>
<racism|sexism|antisemitism|homophobia|islamophobia|transphobia|ableism> <hurts|is a problem for|affects|against|excludes> {gr2} <in our industry|, the study says|everywhere|and must end>
<the|a> <myth|prejudice|stereotype|lie|claim> that {gr2} are {neg} <is false|has no basis|spread in those years|was taught in schools|hurts people>
<gynecology|anatomy|biology|the manual|the doctor> <describes|explains|examines> the <vagina|penis|breast|anus|nipples|uterus|sexual organs> <of mammals|in chapter two|before surgery|and its nerves>
<safe sex|contraception|consent|sexual health|puberty|pregnancy|sexual assault> <is explained|is taught|is covered|is a topic> <in school|in the leaflet|by the clinic|in chapter two>
<your|his|her> <mum|mother|wife|father|family|kids|sister> <called|said|is waiting|sent|left|asked> <the front desk|hello|downstairs|a parcel|early|for you>, please <call back|hurry|tell {name}>
<diese|die> <schnittstelle|abfrage|klasse|funktion> ist <krank|dumm|blöd|mist|scheiße|hässlich|bescheuert>, <die gehört weg|schreib sie neu|leider>
pass auf, <wenn du|dass du|bevor du> <heute|den server|die datenbank|das kabel> <neu startest|löschst|ziehst|sicherst>
<first|then|next|finally|now>, <open|check|read|write|copy|move|build|install|start> the {code} <and|or|before you> <wait|look at the log|ask the owner|run it|set the flag|go on>
<it|this|that|which> <makes|gives|takes|lets|shows|returns|keeps|holds|needs> <you|us|them|the user|the caller> <a|the|no|more|less> <list|copy|chance|control|time|name|number|choice> <of|for|in|over> <the {code}|it|all|each>
<because|since|although|while|unless|until> <we|you|they|it> <did not|do not|never|only|also|still> <use|need|find|see|change|know|have> <it|the {code}|them|this>, <we|you|it> <can|should|will> <wait|skip it|go on|stay the same|be removed>
<the|each|every|one> <user|customer|reader|player|student|member|guest|owner> <gets|sends|picks|pays|writes|opens|keeps> <his|her|their|a|the> <own|first|new|last|free> <name|order|game|page|list|room|ticket|photo>
the {code} <falls|fell|goes|went> back to the <pinned|last|first|default|stale|frozen|cached|old> <version|{thing2}|copy|one|{thing2}>
so {unk} falls back to the <pinned|last|old|{unk}> <{thing2}|{unk}>
<there is|we have|they found> no <test|check|rule|name|room> for <a|the> <pinned|stale|frozen|merged|cold|{unk}> <{thing2}|{unk}>
<a|the|each|every> pinned <{thing2}|{unk}> <needs|holds|keeps|must have|blocks|drops> <a|the> <{thing2}|{unk}>
<pin|unpin|we pinned|it pinned|they pinned> the <{thing2}|thread|memory|comment|package> <to|at|for> <the core|version two|one node|six days|the top>
the <{thing2}|{unk}> has been pinned for <six days|a week|{unk}> and holds on to <its|a> <{thing2}|{unk}>
<pinned|stale|frozen> <packages|versions|rows|pages|messages|threads> <are|were|stay> <never upgraded|kept|in memory|at the top>
the <{thing2}|{unk}> <swallows|swallowed|sometimes swallows> <the|an|every|the wrong> <error|exception|input|signal|{unk}>
the <{thing2}|{unk}> <must|may|should> not be <larger|longer|bigger|smaller|older> than <{unk}|a page|the limit|> <entries|bytes|lines|items>
<one|each|every|neither> <{thing2}|{unk}> out of <nine|ten|the list|many|>, <namely|such as> {unk}, <is|was> <lost|kept|moved>
<der|jeder|kein|unser> <prozess|dienst|server|knoten|nutzer|{unk}> <braucht|hat|sperrt|kennt|will> <seinen|ihren> eigenen <speicher|schlüssel|ordner|zähler|{unk}><, <wenn|aber nicht|sobald> <er leer ist|unter last|es dunkel wird>|>
<el|cada|ningún|nuestro> <servidor|proceso|nodo|archivo|{unk}> <cuenta|lee|pierde|necesita> <dos veces|su propio|solo el primer> <registro|contador|archivo|{unk}>, salvo <con mucha carga|de noche|al arrancar>
and you <have|need> to <name|list|count|write down> <all|each|both> <{unk} |>of <them|these|the {thing2}s>
<the best|the good|one good|the hard|the only good> <part|thing> <about|of> <the {thing2}|the new branch|working with {gr2}|the survey of {gr2}> is that <it builds|they answer early|it is short|they know the field>
<we|the study|the team> <asked|hired|interviewed|counted|invited|trusts> {gr2} because <their|this> <answers|votes|kind of work|letters> <were missing|matter|help|come early>
a <book|talk|letter|paper|patch|film> by <some|two|three of the> {gr2}, <read it|see the notes too|print it, and the notes too|it won a prize>
<keep|hold> <the|our> <blood|water|room|tree|branch|history> <test|samples|clean|cold> <in the lab|before the run|for ten days>
we lose nothing <if|when> we <get rid of|drop|remove|throw out> the <{thing2}|old {thing2}|{unk}> <and keep <the copy|our names|the tree clean>|>
<put|build|we need> a <wall|fence|wrapper|lock> around the <{thing2}|{unk}><, it is <old|slow|not safe>| because its <{thing2}|{unk}> only grows>
the <{thing2}s|rows|{unk}s> are too <big|old|slow|long|many> for the <{thing2}|{unk}> and <must|have to> be kept <out|away|apart> <of it|from it|>
<this|that|a|the|one> piece of <code|the {thing2}|paper|cake|text|work> is <missing|short|old|done|too long> <and everybody knows it|>
this piece of <code|work> is <shit|crap|garbage>, and <it was me|it is mine|we know it>
the <cam|camera|webcam> <shows|sends|turns> <a|the> <private room|token|shaft|live picture|show> <for|to> <the user|anyone with a token|a girl|the class>
<i|we|they> <met|saw|know|visited> the {unk} people <in the valley|at the sea|last year>
<highlanders|islanders|{unk}landers|{unk} people|people from {unk}> <live|sing|fish|vote|eat> <there|at the sea|in the north|well|on sunday>
do <us|me|everyone> a <favour|favor> and <never commit|stop the {thing2}|wake the server|write a test|keep it> <again|first|please>
the <{thing2}|{unk}> never <wakes|woke> up <again|in time|after the signal>
<bin|burn|drop|shred|trash> <it|the {thing2}|the image>, and the <notes|logs|copies> too
<ces gens|ces fichiers|ces élèves|les gens de {unk}> sont <des amis|des touristes|à paris|dans la liste>, <il faut les <appeler|lire|trier>|qu'on les garde|qu'ils attendent>
<esa gente|ese grupo|esa tabla|los de {unk}> <es|son|está> <muy amable|de aquí|vacía|nuevos>, <hay que <llamarlos|leerlos|ordenarlos> a todos|que los guarden>
<diese leute|solche dateien|die aus {unk}> <sind|kommen> <nett|leer|heute|aus bonn>, <man muss sie <lesen|sortieren|einladen>|wir warten>
<watch|see|download> <this|the|our> <explicit|first|whole|private> <tape|clip|video|film|example>, <it|she|he> <takes|shows|explains> <a minute|everything|the first step|it all> <at once|for you|>
<lama|dog|cat|horse|name|bee>, <cow|pig|rat|monkey|snake|whale|sheep|donkey|animal|worm>, <bear|rabbit|duck|falcon|{unk}|snail>
"<lama|dog|ant|horse|name|bee>", "<cow|pig|rat|monkey|snake|whale|sheep|donkey|animal|worm>", "<bear|rabbit|duck|falcon|{unk}|snail>"
<columns|index|set|rows|keys>: <date|class|letter|breed|{unk}>, <animal|cow|pig|whale|dense|rate>, <{unk}|number|name|height>
the <cow|pig|rat|monkey|snake|whale|sheep|donkey|animal|worm> <eats|sleeps|has four legs|is in row three|lives in the sea>
<a|the|two> dense <vector|matrix|layer|index|array|rows|{unk}>, <not a sparse one|sparse|x>, <dot|product|distance|{unk}> 
<run|train|fit|call> <dense|rot|num|trans|mean> <{unk}|out|x>, <axes|size|{unk}>
<you|we|they> should never <modify|change|close> <something|a list|the {thing2}> <you are|while it is|that is> <iterating over|in use|open>
the word is <masked|printed|stored> as <shit|fuck|cunt> in the <log|test|list>"""


def without_accents(text: str) -> list[str]:
    """TEXT as it is written without accents and umlauts, if it has any."""
    if text.isascii():
        return []
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).replace("ß", "ss")
    spelled = re.sub("[äöü]", lambda m: {"ä": "ae", "ö": "oe", "ü": "ue"}[m[0]], text).replace("ß", "ss")
    return [x for x in dict.fromkeys((plain, spelled)) if x.isascii()]


def _choose(sentence: str, rnd: random.Random) -> str:
    """SENTENCE with one of each ``<a|b>`` taken, inner ones first."""
    while "<" in sentence:
        sentence = re.sub(r"<([^<>]*)>", lambda m: rnd.choice(m[1].split("|")), sentence)
    return sentence


def _fill(sentence: str, rnd: random.Random) -> str:
    """SENTENCE with its slots filled; ``{unk}`` is a word of no language, so that unknown words speak for nothing."""
    def entry(m: re.Match) -> str:
        if m[1] == "unk":
            return "".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(rnd.randint(2, 4)))
        return rnd.choice(SLOTS[m[1]].split(";"))

    sentence = _choose(sentence, rnd)
    while "{" in sentence:
        sentence = re.sub(r"\{(\w+)\}", entry, sentence)
    return sentence


def _unmark(marked: str) -> tuple[str, list[tuple[int, int]]]:
    """MARKED without its brackets, and the character spans that they enclosed."""
    text, spans = "", []
    for part in re.split(r"(\[[^\]]*\])", marked):
        if part.startswith("["):
            spans.append((len(text), len(text) + len(part) - 2))
            part = part[1:-1]
        text += part
    return text, spans


# Frequent words of each language, which mean nothing by themselves
COMMON = ["""the of and to in is it that for on with as at by from this be or an are was but if can which has have when there use so what do would more than one
up out only some other into time like then its over also after new any how may where most could first now just see through make way well two such even because
does get here very before between under again too still both while about did had let add read run set why who without note same last next old need want""",
"""der die das und in den von zu mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass nach wird bei einer um am sind noch wie einem über
einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei wenn kann ich wir hier dann diese dieser muss schon immer wieder jetzt beim""",
"""de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont la avec aux sans ou être cette mais on leur peut si comme tout ont
fait nous vous était aussi même elle entre après deux avant encore bien où ici quand chaque donc alors il faut sous""",
"""de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos
también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede todos así nos ni parte tiene él uno donde bien cada aquí ahora"""]
#: Classes of which a clean text may hold any words beside unknown ones, and those of which it holds one at most.
SOFT = "not be will all hope my i they person thing mention kin you your body praise".split()
HARD = "violence death expel evil dehuman group adj vulgar sexverb hate softins steam weapon".split()
_LOADED = {w for c, ws in WORDS.items() if c not in (*SOFT, "be", "i", "all") for w in ws.split()}


def _noise(rnd: random.Random) -> str:
    """Words of classes that mean nothing by themselves among words of no language."""
    out, hard, common = [], rnd.random() < 0.5, rnd.choice(COMMON).split()
    for _ in range(rnd.randint(2, 14)):
        x = rnd.random()
        if x < 0.6:
            out.append("{unk}" if x < 0.3 else rnd.choice(common))
        elif x < 0.9 or not hard:
            out.append(rnd.choice(WORDS[rnd.choice(SOFT)].split()))
        else:
            out.append(rnd.choice(WORDS[rnd.choice(HARD)].split()))
            hard = False
        if rnd.random() < 0.07:
            out[-1] += rnd.choice([",", ":", ";"])
    return _fill(" ".join(out), rnd)


def _shuffled(rows: list[str], rnd: random.Random) -> str:
    """Words of some abusive ROWS that are abusive in no class, in any order among others: none of them speaks alone."""
    ws = [w for r in rnd.sample(rows, 3) for w in r.replace(",", " ").split() if w not in _LOADED]
    rnd.shuffle(ws)
    ws = ws[: rnd.randint(3, 12)]
    for _ in range(rnd.randint(0, len(ws))):
        ws.insert(rnd.randrange(len(ws) + 1), rnd.choice(["{unk}", rnd.choice(rnd.choice(COMMON).split())]))
    return _fill(" ".join(ws), rnd)


#: Modules of the standard library whose documentation and comments are plain text, too.
_MODULES = """argparse ast bdb calendar cmd codecs concurrent.futures.thread configparser copy csv datetime difflib doctest email.message enum fileinput
    fractions ftplib functools gettext heapq http.client http.cookiejar imaplib inspect ipaddress locale logging mailbox mimetypes optparse os pathlib
    pdb pickle pickletools platform poplib pprint profile pydoc random sched selectors shelve shutil smtplib socket socketserver statistics string
    subprocess tarfile tempfile textwrap threading timeit trace traceback turtle types typing unittest.case unittest.mock urllib.request uuid
    warnings wave weakref webbrowser xmlrpc.client zipfile""".split()


def _plain_texts() -> Iterator[str]:
    """Python's language reference, docstrings and comments of its library: plain English that comes with the interpreter."""
    yield from (v for _, v in sorted(topics.items()))
    for name in _MODULES:
        spec = importlib.util.find_spec(name)
        source = spec.loader.get_source(name) if spec and spec.loader else None
        if source:
            yield "\n\n".join(re.findall(r'"""(.*?)"""', source, re.S))
            yield re.sub(r"\n#", "\n", "\n".join(re.findall(r"^[ \t]*((?:#.*|))$", source, re.M)))


def _prose(most: int, rnd: random.Random) -> list[str]:
    """At most MOST sentences of the plain texts."""
    found = [" ".join(x.split()) for text in _plain_texts() for x in re.split(r"\n\s*\n|(?<=[.:;])\s", text)]
    found = [x for x in found if 4 <= len(x.split()) <= 40]
    return rnd.sample(found, min(most, len(found)))


def labelled_rows(seed: int, draws: int, noise: int = 30_000, shuffled: int = 30_000, prose: int = 16_000) -> list[tuple[str, list[tuple[int, int]]]]:
    """Sentences with the character spans that are abusive: DRAWS of each sentence above, some beside a clean one.

    Those with a choice are drawn twice as often. NOISE, SHUFFLED and PROSE are numbers of clean rows of these kinds.
    """
    rnd, out = random.Random(seed), []
    clean = CLEAN.split("\n")
    for kind in (TOXIC.split("\n"), clean):
        for s in kind:
            for k in range(2 * draws if "<" in s else draws if "{" in s else max(1, draws // 3)):
                one = _choose(s, rnd)
                gaps = [m.start() for m in re.finditer(" ", one)]
                if kind is not clean and gaps and rnd.random() < 0.2:
                    g = rnd.choice(gaps)
                    full = _fill(one[:g] + " {unk}" + one[g:], rnd)
                else:
                    full = _fill(one, rnd)
                if rnd.random() < 0.15:
                    full = rnd.choice(without_accents(full) or [full.replace("'", "").replace(",", "")])
                if k % 3 == 1:
                    full = _fill(rnd.choice(clean), rnd) + rnd.choice([", ", " and ", " - ", ": ", " "]) + full
                elif k % 3 == 2:
                    full += rnd.choice([", ", " and ", " - ", ", but ", " "]) + _fill(rnd.choice(clean), rnd)
                out.append(_unmark(full))
    abusive = [t for t, spans in out if spans]
    out += [(_noise(rnd), []) for _ in range(noise)]
    out += [(_shuffled(abusive, rnd), []) for _ in range(shuffled)]
    return out + [(x, []) for x in _prose(prose, rnd)]
