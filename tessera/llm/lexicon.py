"""Word lists of the abuse scorer, in English, German, Spanish and French; lower case, without accents.

General vocabulary of each category, as found in dictionaries; a trailing * stands for any ending. The scorer adds
what it learns from labelled documents, so the lists need not be complete.
"""

#: Words that insult a person.
INSULT = """
idiot* moron* imbecil* cretin* halfwit* dimwit* nitwit* loser* scum scumbag* bastard* asshole* arsehole* dickhead* bitch* whore* slut*
cunt* twat* prick wanker* tosser* douche* jackass* dumbass* retard* braindead brainless spineless worthless pathetic disgusting
stupid dumb filthy fatso freak* pig pigs failure clown* coward* ugly trash garbage
vollidiot* trottel* schwachkopf* dummkopf* depp deppen arschloch* hurensohn* wichser* schlampe* versager* drecksack* drecksau* missgeburt*
abschaum spast* schwein* dumm dumme dummes dummer dreckig* widerlich* wertlos* fotze*
idiota* imbecil* cabron* gilipollas pendejo* estupid* inutil* hijoputa puta putas puto maricon* zorra* cerdo* escoria basura asqueros* subnormal* payaso* tonto* sucia sucio mierda
connard* connasse* salop* salaud* abruti* cretin* batard* enfoire* encule* pute putes ordure* debile* minable* crasseu* degueulasse* imbecile* porc porcs gros sale merdeux raclure*
""".split()

#: Sexually explicit words.
SEXUAL = """
porn porno* pornos nude nudes naked tits boobs breasts cock cocks dick pussy vagina penis milf* horny orgasm* moan* fuck fucked fucking blowjob* cum cumming
panties undress* undressed lick licked licking suck sucked sex sexy erotic* striptease masturbat* anal threesome* escort* cams busty skirt
nackt nackte nackten nacktbild* geil geile geiler fick* titten brueste bruste muschi schwanz stohnte stohnen orgasmus nutte* wichsen sexbild*
desnud* follar follaba follo polla cono tetas gemia cachond* corrida pornografi* caliente calientes desvist* chupa* lamer
nue nues baiser baisait bite chatte seins gemissait bander nichons deshabill* coquine* salopes chaleur lecher sucer photos
""".split()

#: Threats of harm and wishes of death.
THREAT = """
kill kills killed killing die dies dead death murder* choke hang hanged strangle* shoot shot stab* beat beaten bat burn rape* rot bleed slaughter* fingers bones throat
yourself suicide bridge jump jumped jumped hurt destroy wiped hunt watch find address live meat
sterben stirb verrecke* toten tot umbring* umbringen schlag schlage erschiess* erhang* wohnst totschlag* abstechen knochen
matar matare muere muerete morir muerte romper golpear ahorca* vives rajar cara piernas
tuer creve crever meurs mourir mort casser gueule egorg* etrangl* habites frapper pendre bruler
""".split()

#: Words that deny people their worth, or call for their removal.
DEHUMAN = """
vermin subhuman* parasite* savage* rats rat cockroach* plague disease animals animal monkey* ape apes inferior breed infest* invader* swarm* cage cages deport* exterminat* wiped expel* gas stink* infect* thrown locked steal
ungeziefer parasiten* untermensch* ratten tiere vernicht* ausrott* abschieb* einsperr* rausgeworfen pack gesindel seuche
alimana* parasito* ratas plaga exterminar* encerrar* deportar* infrahuman* bichos expulsar*
vermine* racaille* parasite* rats cafard* exterminer* enfermer* virer expulser* sous hommes humains humain
""".split()

#: Words for groups of people.
GROUP = """
immigrant* foreigner* migrant* refugee* women woman men people they them those team family blacks whites jews muslims gays lesbians
auslander* einwander* frauen leute menschen fluchtling* diese dieses alle
extranjer* inmigrant* mujeres personas gente esos estos refugiad* humanos
etranger* immigre* femmes gens refugie* ces ceux
""".split()

#: Address of a person.
SECOND = """
you your yours yourself youre u ur du dich dir dein deine deinen euch ihr tu te ti tus vosotros usted eres vete callate ta ton tes toi vous votre es ferme
""".split()

#: Third persons.
THIRD = """
he him his she her hers they them their er sie ihn ihm ihre el ella ellos ellas su sus lo la los las il elle ils elles lui leur
""".split()

#: Swearing that is often about things.
SWEAR = """
damn crap shit shitty bullshit hell fuck fucking sucks garbage ugly stupid idiotic bloody scheisse mist verdammt kacke mierda joder carajo merde putain bordel
""".split()

#: Words of filters, lists, rules, definitions and reports about such language.
META = """
filter* blocklist* denylist* stoplist* wordlist* list lists terms term rule rules conduct moderator* report* users must flag* detect* classif* stored column false positives hate speech abuse policy schema word words plural locale* test tests notes
sperrliste* filterliste* liste regel* begriffe meldung* wort worter
lista* bloqueo filtro* regla* termino* palabra* guarda
liste* blocage filtre* regle* terme* mot mots code
""".split()

#: Words of code and machines.
TECH = """
process parent child thread queue job build parser loop code offset* pointer* api node cache buffer* fencing battery netlist locale* palette recipe cursor batch block header key ledger page record row segment session shard token tuple window bucket frame entries entry
kindprozess elternprozess prozess speicher zeiger proceso hijo padre memoria puntero processus enfant memoire pointeur fils
""".split()

#: Letters of other scripts that look like Latin ones, and the Latin letters they stand for.
LOOKALIKES = dict(zip("аеорсухіјѕһԁɡӏкмнтвοαερικντυχ", "aeopcyxijshdglkmhtboaepikvtux", strict=True))
#: Digits and signs written for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}
#: Characters without width that hide inside words.
HIDDEN = "​‌‍‎‏⁠﻿­"

CATEGORIES = {"insult": INSULT, "sexual": SEXUAL, "threat": THREAT, "dehuman": DEHUMAN, "group": GROUP, "second": SECOND, "third": THIRD, "swear": SWEAR, "meta": META, "tech": TECH}
