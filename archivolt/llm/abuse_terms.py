"""Words of abuse and of its grammar by role and language, idioms, and the patterns of roles that make abuse.

They are plain word lists for review and exclusion. In phrases ``~`` lets up to
four other words stand between. In patterns a role is followed by how many
other words may stand before the next one.
"""

#: Abusive by themselves.
STRONG = {
    "insult": """
        asshole arsehole motherfucker fucking fucker cunt slut whore wanker bellend dickhead shithead bullshitter jackass scumbag dumbass dirtbag douchebag bitches bastards
        moron cretin imbecile dipshit twat halfwit retard scumbags tosser knobhead pillock cocksucker
        connard connasse salaud salope enculé pute putain fumier merdeux bâtard trouduc
        arschloch wichser schlampe hurensohn hure fotze drecksau drecksack missgeburt dreckskerl vollidiot mistkerl
        gilipollas cabrón pendejo puta mierda maricón hijoputa cabrona subnormal
        мудак мразь сволочь ублюдок сука хуй хуйло пизда блядь блять ебать гандон гнида пидор курва шлюха
    """,
    "sexual": """
        fucked fucks fuck blowjob handjob cumshot tits cumming
        baisée baisé baiser fickte ficken gefickt follar folló follada трахнул трахнула трахать трахал выебал
    """,
}
#: Abusive where the words around them say so.
DEPENDING = {
    "insult": """
        bitch bastard prick swine scum idiot ass arse dick pig rat worm liar fool shit vermin pussy cock trash filth crap loser coward parasite maggot cockroach
        ordure chien porc idiote crétin schwein sau trottel cerdo idiota basura imbécil rata
        тварь идиот свинья скотина дурак крыса падаль
    """,
    "sexual": """
        cock pussy nipples thighs moan moaned naked genitals stockings lick licked suck sucked stroked stroke breasts panties undressed spread orgasm wet came crotch
        seins cuisses nue nackt brüste desnuda pechos голая юбку ноги
    """,
}
#: Roles in sentences of threat and hatred. Words of three letters or less count as they stand, longer ones however spelled.
ROLES = {
    "kill": """
        kill murder stab shoot strangle lynch butcher slaughter behead exterminate throttle gas eradicate disembowel
        umbringen töten erschlagen erschießen erstechen abstechen aufhängen vergasen ausrotten totschlagen kaltmachen
        tuer crever égorger étrangler noyer exterminer buter matar degollar ahorcar apuñalar exterminar matarte matarlos ahogarlos
        душить вешать перебить истребить убить зарезать
    """,
    "hurt": """
        cut slit break smash beat whip burn bury crush skin blow hang drown knife poison maim cripple gut gouge
        einschlagen verbrennen brechen schlage casser brûler romper quemar reventar partir
    """,
    "myself": "убью зарежу задушу повешу пристрелю проломлю сожгу порежу",
    "killed": """
        shot hanged hung gassed exterminated burned burnt drowned butchered slaughtered lynched executed killed murdered eradicated
        ausgerottet vergast erschossen aufgehängt noyés exterminés pendus exterminados ahorcados
    """,
    "body": """
        throat throats neck leg legs bone bones arm arms face skull head brains teeth eyes knees fingers
        gesicht schädel zähne genick knochen gueule gorge dents yeux cara cuello huesos dientes garganta голову глотку горло
    """,
    "you": "you your yours yourself tu te toi ton ta vous votre du dich dir dein deine tú ti ты тебя тебе твою твоя вас",
    "exactly_you": "you dich dir te toi тебя вас",
    "yourself": "yourself yourselves",
    "him": "him her his them their ihn ihm lui его её их",
    "will": "will i'll we'll shall going gonna want ought should must somebody someone better would werde wird wirst werden vais va allons voy vas vamos hay faut надо",
    "we": "we we'll let us i i'll wir nous nosotros мы",
    "group": "they them these those people everyone foreigners immigrants all lot race tribe les sie alle los todos всех их они",
    "such_a_group": "этих тех diesen ces estos esos",
    "ought": "should must ought deserve deserves need gehören sollten faut hay надо нужно",
    "be": "be to get",
    "are": "are is sind sont son we're they're",
    "vermin": "vermin lice parasites subhuman subhumans cockroaches maggots animals beasts ungeziefer untermenschen vermine basura cafards parásitos твари паразиты",
    "breed": "breed multiply spawn vermehren",
    "like": "like wie comme como как",
    "rot": "rot die burn suffer choke verrecke crèves revientes сдох сдохни",
    "hope": "hope wish чтоб",
    "know": "know weiß sais sé знаю",
    "where": "where which when wo où donde dónde где",
    "at_home": "live lives sleep sleeps walk walks work works home house children school wohnst habites vives живешь живет",
    "dead": "dead corpse tot mort muerto труп",
    "houses": "houses homes churches villages shops temples mosques",
    "before": "before until till",
    "not": "not no never nie nicht pas",
    "human": "human humans people menschen humains humanos люди",
}
#: (category, score, roles with the words that may stand before the next one). ``^`` starts a sentence or a line; ``the`` is any word of a group.
PATTERNS = (
    ("threat", 0.95, "will 4 kill 3 you"),
    ("threat", 0.95, "will 3 hurt 0 exactly_you"),
    ("threat", 0.95, "will 4 hurt 3 you 2 body"),
    ("threat", 0.90, "hurt 2 you 1 body"),
    ("threat", 0.90, "will 3 hurt 1 him 1 body"),
    ("threat", 0.80, "we 1 will 2 kill 1 him"),
    ("threat", 0.95, "will 2 exactly_you 3 kill"),
    ("threat", 0.95, "exactly_you 1 will 2 kill"),
    ("threat", 0.90, "will 2 exactly_you 4 hurt"),
    ("threat", 0.95, "exactly_you 1 will 2 hurt 2 body"),
    ("threat", 0.90, "exactly_you 0 hurt 3 body"),
    ("threat", 0.90, "body 1 will 2 hurt"),
    ("threat", 0.95, "myself 2 exactly_you"),
    ("threat", 0.95, "exactly_you 2 myself"),
    ("threat", 0.90, "hope 1 you 2 rot"),
    ("threat", 0.90, "know 2 where 5 you 6 at_home"),
    ("threat", 0.90, "know 2 where 5 at_home"),
    ("threat", 0.80, "you 1 are 2 dead"),
    ("insult", 0.95, "kill 0 yourself"),
    ("insult", 0.90, "hurt 0 yourself"),
    ("hate", 0.95, "group 5 ought 1 be 1 killed"),
    ("hate", 0.90, "ought 1 killed"),
    ("hate", 0.90, "ought 2 kill 2 group"),
    ("hate", 0.90, "ought 1 group 1 kill"),
    ("hate", 0.90, "such_a_group 4 ought 1 kill"),
    ("hate", 0.90, "group 1 kill"),
    ("hate", 0.90, "kill 0 group 1 group"),
    ("hate", 0.95, "^ 0 kill 3 before 2 breed"),
    ("hate", 0.85, "the 1 are 2 vermin"),
    ("hate", 0.90, "group 3 breed 0 like 1 vermin"),
    ("hate", 0.90, "the 1 are 0 not 1 human"),
    ("hate", 0.85, "we 2 hurt 2 houses 6 group"),
    ("hate", 0.85, "we 2 hurt 2 houses 2 the"),
    ("hate", 0.80, "they 2 like 1 vermin"),
)
#: Idioms of abuse.
PHRASES = {
    "insult": """
        son of a bitch|piece of shit|dirty little worm|filthy rat|stinking pig|dirty dog|go to hell ~ you
        hijo de puta|ta gueule|halt die fresse|halt dein maul|sale con|fils de pute|пошел ты|пошла ты|на хуй|заткнись|cierra la boca
        do not deserve to live|does not deserve to live|good for one thing only
    """,
    "threat": """
        shut it for you|put a bullet in your|put a bullet in you|will not live to see|beat you to death|blow your brains
        чтоб ты сдох|crever les yeux
    """,
    "hate": """
        gas the lot|string them up|go back where you came|hunted down like|no better than animals|shot like dogs|hanged like dogs|breathe the same air|wipe them out|a plague on this country
        driven into the sea|echarlos al mar|dance while they scream
    """,
    "sexual": """
        until he came|until she came|spread her legs|spread your legs|on their backs with|with their legs open|couche avec tout|treibt es mit jedem|задрал ей юбку|раздвинула ноги|раздвинь ноги
    """,
}
#: Words near a hit that point to abuse of somebody.
TOWARDS = """
    you your yours yourself you're what real nothing called told listen shut rot hope hell damned dirty filthy stinking useless worthless bloody fucking lousy rotten stupid
    tu toi ta ton qu'un espèce sale cette du dich dir bist diese dieser eres tu ese esa maldito un ты тебя твоя последняя пока такая такой
"""
#: Words of persons that sexual wording is about.
PERSONS = "his her your my you him she he me their sie ihr ihre elle su ella ей её"
#: Words near a hit that point to animals, plants, tools and other innocent uses.
INNOCENT = """
    kennel whelped litter breeds dog dogs puppy hens rooster fighting crow file chisels needle pin thorn cat mules donkey ox farm farmer sty bacon laboratory trap
    mile ball tap gun hunt garden plant flower bird shop swim
"""
#: Words near a hit that report what somebody else said.
REPORTING = """
    said wrote shouted quoted quote letter words testified record alleged according exhibit read cried called
    dit écrit sagte schrieb dijo escribió сказал написал
"""
