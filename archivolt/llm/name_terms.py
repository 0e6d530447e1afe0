"""Titles, particles, given names with their short forms, and words of organisations with their abbreviations."""

TITLES = frozenset("mr mrs miss ms dr prof professor col colonel capt captain lt lieut lieutenant maj major gen general sgt rev sir lady lord comrade senator judge adm admiral hon com cde".split())
PARTICLES = frozenset("de von van der den da di du la le del af zu bin ibn".split())
SUFFIXES = frozenset("jr sr ii iii esq phd".split())

#: canonical: short forms and spellings in other languages.
GIVEN = {
    "abraham": "abe abram avram", "aleksandr": "sasha alexander alex alec sanya aleksander", "alfred": "alf fred alfie", "anastasia": "nastya stasya tasya anastasiya", "andrei": "andrew andy andrey",
    "anna": "ann anne annie anya", "augustin": "gus august augustine", "benjamin": "ben benny benjie", "bernard": "bernie barney", "boris": "borya", "catherine": "",
    "charles": "chuck charlie karl carl chas", "clifford": "cliff", "daniel": "dan danny", "david": "dave davy", "dmitri": "dima mitya dmitry dimitri", "dorothea": "dolly dora dot dottie dorothy thea",
    "edward": "ed eddie ned ted teddy eduard", "elizabeth": "betty beth liz lizzie bess eliza elisabeth libby", "eugene": "gene evgeny yevgeni", "francis": "frank frankie fran", "frederick": "freddy freddie fritzi",
    "friedrich": "fritz", "george": "georgie georgi", "gerald": "gerry jerry", "gregory": "greg", "grigori": "grisha grigory", "harold": "harry hal", "heinrich": "heinz heini", "helen": "nell nellie", "henry": "hank",
    "igor": "", "irina": "ira", "ivan": "vanya", "jacob": "jake", "james": "jim jimmy jamie jas", "johannes": "hans", "john": "jack johnny jno", "joseph": "joe joey josef", "josephine": "josie jo",
    "katherine": "kate katie kathy kitty katharine kathleen", "lawrence": "larry laurie laurence", "leopold": "leo poldi", "lev": "lyova", "louis": "lou lewis", "margaret": "peggy meg maggie margie greta",
    "maria": "mary masha molly", "martin": "marty", "matilda": "tilly tillie mattie", "michael": "mike mick", "mikhail": "misha", "nathaniel": "nat nate nathan", "nikolai": "kolya nikolay nicholas nick", "olga": "olya",
    "patrick": "pat paddy", "paul": "", "pavel": "pasha", "peter": "pete pyotr", "philip": "phil pip phillip", "rachel": "", "richard": "dick rick dickie", "robert": "bob bobby rob bert robbie", "rosalind": "roz rosie ros",
    "samuel": "sam sammy", "sergei": "seryozha sergey serge", "sophia": "sophie sonya", "stephen": "steve steven", "tatiana": "tanya", "theodore": "theo", "thomas": "tom tommy thos", "ulysses": "lys lyss uly",
    "victor": "vic viktor vitya", "vladimir": "volodya vova", "walter": "walt wally", "wilhelmina": "minna mina minnie willa", "william": "bill will billy willie wm liam", "yekaterina": "katya ekaterina",
}

#: Kind of organisation: abbreviations.
KINDS = {
    "company": "co coy", "corporation": "corp", "institute": "inst", "committee": "cttee comm cmte ctee", "society": "soc", "association": "assn assoc", "department": "dept", "laboratories": "labs lab laboratory", "bureau": "bur",
    "agency": "agcy", "bank": "bk", "brothers": "bros", "union": "", "ministry": "min", "trust": "", "league": "", "college": "coll", "university": "univ", "foundation": "fdn", "works": "wks", "limited": "ltd", "incorporated": "inc", "syndicate": "synd",
}
ACTIVITIES = {
    "import": "imp", "export": "exp", "shipping": "shpg", "chemical": "chem", "optical": "opt", "trading": "trdg trad", "mining": "mng min", "publishing": "publ pub pubg", "research": "res rsch", "relief": "rel relf", "electrical": "elec elect",
    "steel": "", "oil": "", "press": "", "insurance": "ins", "engineering": "eng engrg", "textile": "text", "motor": "mot", "aviation": "avn", "railway": "rly ry", "medical": "med", "technical": "tech", "scientific": "sci", "agricultural": "agric",
    "industrial": "ind", "commercial": "comml", "financial": "fin", "construction": "constr", "transport": "transp",
}
FILLERS = frozenset("the of and for & a".split())
