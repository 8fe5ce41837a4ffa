"""English words that are cheap to guess, most common first: those used twice or more in the language reference of Python, and some more."""

COMMON = """
class object function method type name statement exception self used other attribute instance module will expression when which list return also only
defined same code version should objects sequence have except argument arguments built values must dictionary using types following clause pattern
called suite methods number they tuple such first then parameter within given namespace names block case than call identifier does classes attributes
keyword raise definition executed functions more characters import special current global result operations implementation evaluated variable line
section there implement returns character variables assignment execution context items empty created base support mapping parameters raised annotation
item target syntax bound finally operation most length scope point left iterable expressions like their sequences local keys comparison form raises
positional else equivalent single each after where reference either always before found through define subject mutable standard cannot last strings
statements descriptor integer present these assigned right range equal instances defines containing those operator bytes numbers passed lists start
literals order specified corresponding different manager interpreter index three async returned frame command part contains match yield numeric uses
means scopes into occurs slice were being been including some while explicitly dict zero negative behavior binding possible body available described
continue generic program normal both references next step iterator over level metaclass between multiple instead nested data whose matches original
immutable implemented elements width debugger exceptions create rather considered annotations contain calls runtime yields unless future error provide
directly evaluation literal without break allows operators formatting time traceback breakpoint digits division represent loop matching information
arbitrary decimal stack slicing definitions nonlocal evaluate optional decorators would invoked precision option source count defaults await imported
complex another subclass valid compare handler patterns about added appropriate even floating otherwise converted integers container format copy field
simple rules treated read because owner arithmetic operand enclosing commands evaluates least primary detail handled actually examples sets itself
space sign indicates mappings display refer comma less during assignments coroutine documentation search override additional formal semantics until
calling builtins determined subscription similar meaning stored iteration made identity common custom note hash contained group stop view generator
specification binary augmented back done them allow identifiers modules follows below lookup whether required allowed execute alias representation
prefix presentation include place addition inside asynchronous leading still certain globals descriptors float recent formatted file separator
separated resulting square side pair never static text customize property control accessed interpreted defining once stdin immediately cases provided
typically exist lines omitted change digit feature debugging under brackets trailing occur already keywords aliases total setting protocol followed
follow particular around clauses caught guard func lambda above constructor currently latter targets hand exactly removed named supports needs attr
declared slot inheritance customized since bitwise truth useful need executes introduced collections garbage condition pairs conversion args hashable
free chars parentheses cause usually specific tuples provides exit transformed computed language event accept represents affect just creation bases
results modulo second executable appear notation library handling versions replacement represented table bytecode remaining applies iter underscore
callable changes derived replaced nearest specify contents becomes doesn binds iterate continues entire normally subpatterns terms star defparameter
full help reflected lineno efficient buffer enclosed creating refers description bounds collection regular proper package important auditing
specifying general overridden listed needed produce priority power intended compiled written flow supplied explicit often effect retrieved abstract
bytearray tests words substring header selects locals generally underlying resolution supported identified print concatenation resolved errors
happened includes unary membership newline escape bind depending various hierarchy operands automatically however spam deletion fails take implicit
specifies kind dynamic precedence depends classmethod saved slots check output decorator metaclasses what equality well cleanup repeated deleted
managers against guaranteed subpattern double constraints related cased subclasses environment correctly insertion features encoding trace bpnumber
removes suffix maxsplit backslash four convenient assign apply actual difference proposal semantically outside occurring inserted imaginary avoid
invocation third looked decorated declaration works parent applied style containers dictionaries terminates possibly interpretation rich constructed
based compared ordered ordering executing testing makes previous usage loaded later included quotes matched blocks succeed irrefutable real times
fixed formed lazily recommended interactive breakpoints script letters locale make fail details copied quote fill positive indices reverse bacon views
compile lower unpacking private writable points running lexical searched accessible appears adding invoke bindings individual differ prevent floor
known boolean roughly comprehension excess although grammar comparisons direct element frozenset colon clear rest translated exited soft further byte
penguin options implements builds enabled greater referenced entries occurred fields align larger representing bits indexed requested prefixed many
previously creates properties existing implies modified caused enter attempt occurrence mechanism inserting delete starting neither automatic
repetition builtin convert processed could inherit checkers changed though implementing restriction handlers reached handle cycle reraise wrapped
guarantees write takes skip steps associated modifies declarations implicitly causes files compute look fall size recognized whitespace filename
ignore qualified digitpart alignment position category uppercase lowercase falls shift kwargs column assert assigns recursively outer occurrences
subscript upper evaluating typing funcname able longer hence looking sensitive store converts overrides customization likely require passes inspect
indicate unbound said desired overriding strictly commonly syntactically filled purpose therefore compound illegal virtual surrounding cleared
attached preceding temporarily proceeds reason ignored discussed succeeds flag every detected work syntactic initialized again entry necessary printed
resource extension usable requires process interface displays ways aligned centered coefficient large emulate become memory behaviour fillchar
spacious splits escapes juice sorted failed message attributeref starred rebound asked leaving combination augtarget unlike performs performed mangled
parenthesized coroutines begins underscores accesses raising accessing weak produced multiplication absolute really placed determine shared collected
descriptions newly mostly preserved much lead indirect fact across numerical ranges internal depend iterating groups separate conditional elif starts
handles grouping denote logical precise unchanged missing anything purposes quoted established users several happens wrapper gets mentioned enables
immediate lazy propagated inherits memoryview docstring state resources suppress upon returning together doing frames themselves post mortem
understood prompt debug debugged active indicated convenience system remove jump namespaces word braces denotes earlier introduce contexts flags octal
zeros letter significant shows respectively restrictions reserved public relative release nothing indexes proxy algorithm comparing removing extra
iterated eggs sausage sorting optimization displayed perform optionally asterisk minus final necessarily replace thus taken sometimes augop assigning
looks consists transformation member rule lookups parents party expected chain contrast declare members speed limited child retrieving levels former
mathematical equals passing produces providing regardless having proposed classname gives discarded restrictive unexpected chained imply indirectly
identities unequal performance consistency initialization subsequent problem tested skips generate inner along suppressed background input success
shorthand capture scoping usual compares duplicate accepted receiving defaulting presence hint forward behave listing kinds flavors translation
capitalized registered invoking wishes modifying ensure destroyed warning informal printable singleton swapped reflection python retrieve unhashable
checking affects want explained kwds give typed determines interact curly comprehensions exceptional model find main selected constructs structural
beginning extends introduces anywhere exponent escaped padding scientific show latitude longitude coord center compatibility compiler ternary ndigits
sense close open unique preserve versus improper stride hook meets enum might parameterized getattribute positions database stripped delimiter
backslashes finite intrinsic instruction yielded accepts dictview operates expr circumstances modify writes subscripted invalid prints updated achieve
annotated tools suspended standalone supporting textually front floatnumber obtain intentional reasons infinite meaningful deletions sorts excluding
dotted staticmethod inheriting action conventional smaller printf series unfilled calculated consequence unpackings classdef perhaps motivation
intuitive identical inputs consistent enforce negation inverse ends funcdef suites long repeats turn keeping alive reset combined leaves encapsulated
location surrounded failure attempted successful rely exact dependent cache bubbles happen purely failing corresponds forms stops soon construction
expressed especially appending anonymous powerful preserving primarily subtype locking describe caller conversions postpone cyclic cycles nicely
differs convention paragraph interoperate attempts remain constant invocations easily tracebacks typical restart optimized slightly nosigint readrc
touch tracing spaces exclamation entered separating split directory breaks stopping bottom originally initialised recursive very resolving breaking
piece relied limitation searching extend resolve pointfloat share brace preceded specifiers coercion dynamically alternate thousands aware formats
directive referred plus titlecase backwards ordinary basic loading initializing commas locally dots behaves prior integral situations whenever math
delegation mutability unreachable detection linked keep external almost chaining approach involving tightly subscripting consider degree cell cost
strict according excepting combinations mapped splitting consecutive keepends stringprefix longstringitem shortbytesitem longbytesitem bytesescapeseq
triple machine getting updates storing shallow dishes symbol easier imposed reversed concatenating meet economy remind sort extended assume ultimately
decide validity causing exists nonnegative maps overlaps rewritten lastly caveat applicable expressing hints resumed suspend aenter aexit concept atom
independent stringliteral bytesliteral imagnumber correspond evaluations tree asymmetry efficiency recursion bypassed wants fine grained appropriately
assist introspection callables continuing assembled simplest invokes searches redefinition redefine acquire behaviors deny significantly improved
reserves prevents unlisted overwrite inaccessible renders nonempty docstrings recognised slotted layouts violations awaitable matrix remainder
connected subtraction exclusive inclusive skipping keeps translates parse receives iterables unusual confusion acceptable advanced finishes reliable
heavily decorating hides shifting legal pretty notion think describes involved mathematically counter singletons lets enforces superset relations
undefined exhaustive illustrate marked tried whole finalization controlled semicolon indented begin ambiguities repeatedly goes exhausted overwrites
overwritten finished successively inspects canceled partial ambiguous wrap multi vary notations assertion illustration reflect vertical obtained
manner bool opening parenthesis understand keyed postponed merely simplified eager typevar typevartuple paramspec wraps come plain stands reality
appearing saving restoring unlocking closing opened phrase superclass mainly constructing finalizer improperly destruction resurrection resurrected
register decrements reaches going collector precarious lock blocking deadlock interrupted assuring official recreate expectation concise delegate
correspondence symbols delegates inverts implied relationships among notes subclassing hashed advised components play packing hashing truncates sizes
sure easy wrong bucket retain told incorrectly salted unpredictable random predictable protection denial service carefully chosen exploit worst http
advisories ocert varies randomization extract mode explanation console instantiating completekey stdout originate controls enable blank assumed middle
workaround temporary resumes home disable remains terminate desirable nearly giving jumps dedicated modifications move switch rightmost detects
termination repair retry entering offending received carry messages unbind visibility visible lacks scanning precede contrasts mutually restricted
wanting exponentfloat fraction parts delimited players converting presented mini substituted specifications printing minimum differently hexadecimal
adds respective signals prefixes indicating unicode floats infinity switches shown char answers octets holds parsed besides alongside conjunction
gettext unused informally dunder documented breakage clashes unicodedata unlimited categories others normalization marks combining parser hooks making
incompatible started decinteger bininteger octinteger hexinteger nonzerodigit bindigit octdigit hexdigit limit complicated ancestors losslessly
truncated address unchangeable immutability omit matter counting collects catching strongly talk something highest lowest numerically assuming
distinguishes instantiated permitted allowable behaving estimated didn exclusively inappropriate loops expect removal iterates supply tries allowing
retrieval machinery candidate closure super functionality signify absence interpret attempting bypassing flexibility covers lowercasing encoded
checked build tabsize born country alphanumeric titlecased uncased justified ordinals delimiters consisting boundaries newlines apostrophes bill
indexing ordinal shortstring longstring longstringchar shortbytes longbytes bytesprefix shortbyteschar longbyteschar unescaped xxxx xxxxxxxx
eventually unrecognized sole arrays mask obey alist initialize pathname best practices working please clears update updating offsets small offset
towards events writing suitable jack sjoerd shortcut containment reduced appends inserts retrieves reverses reversing interfaces concrete homogeneous
calculating heterogeneous formula inversion everything everyone someone anyone understanding development government experience business education
relationship community communication management technology difficult beautiful wonderful confidential encrypted generated protected forgotten expired
disabled rotated revoked permanent successfully username usernames passwords credentials authentication authorization administrator configuration
production staging unknown hopefully simplicity patience persistence practice preparation honesty happiness friendship kindness knowledge wisdom
butter chocolate garlic cinnamon
""".split()
