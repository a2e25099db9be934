"""Template residue, filler text, error pages and script notices in place of content.

A text is taken apart once into messages: the body of each cue, or a block between blank lines. A message that no rule
could call residue is dropped in that scan, as most dialogue is. The others are normalised, with numbers, addresses, ids and
dates masked, and grouped by an exact 128-bit hash over all documents and sources, so that a message that stands in a third of
all cues is judged once, with the number of documents and sources it recurs in. The rules need no list of messages:

* placeholders by their form, which a line of dialogue may hold, and bracketed names of fields;
* values that programs print in place of text, and phrases made of words of empty slots alone;
* pages of markup or status objects, status numbers with their names, errors that name code;
* filler by its vocabulary;
* notices: a technical thing and a failure or request, and no words but those of notices. Where a message recurs
  in one of WIDE_SHARE documents and in several sources, one word in six may be any, as its wording is then no accident.

A sentence of dialogue that merely speaks of an error has other words too and is no match. Up to SPREAD neighbouring
cues that have only words of notices are judged together as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.operators.spread import spread_join
from termweave.session import cut

# Written for this module: how the cues of subtitle files are told apart, and marks that only lay text out.
CUE_HEAD = r"(?:^|\n)[ \t]*(?:\d+[ \t]*\n[ \t]*)?\d{1,2}:\d\d(?::\d\d)?[,.:]\d{1,3}[^\n]*\d\d[,.:]\d{1,3}[^\n]*(?:\n|$)|\n[ \t]*\n"
LAYOUT = r"</?(?:[ibus]|font|c|v|lang|ruby|rt)(?:[ .][^<>]*)?>|\{\\[^{}]*\}|[\x{FEFF}\x{200B}\x{200D}\x{AD}]"

# Written for this module: words of the usual filler text.
FILLER_WORDS = """
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna
aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute
irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non
proident sunt culpa qui officia deserunt mollit anim id est laborum
"""

# Written for this module: more words of generated filler, for texts that are filler for the most part.
MORE_FILLER = """
pellentesque habitant morbi tristique senectus netus malesuada fames turpis egestas vestibulum tortor quam feugiat vitae
ultricies eget curabitur suspendisse vivamus maecenas phasellus praesent quisque integer nullam donec aenean mauris
faucibus luctus posuere cubilia sollicitudin condimentum sagittis porttitor tincidunt dapibus vulputate sodales
volutpat pulvinar bibendum dignissim fringilla interdum lobortis rutrum venenatis viverra
"""

# Written for this module: per language the words of notices: technical things; failures and requests; what stands around them.
NOTICE_WORDS = """
page website webpage url server servers session browser javascript script scripts scripting cookies database subtitle subtitles caption captions track player connection connections network service api login access plugin timeout timed gateway proxy host http account download downloads upload stream occurred file files exception limit quota cookie cdn token security certificate firewall router endpoint device account's username password credentials robot captcha resource resources pages maintenance request requests status encountered video videos content something problem problems issue playback media streaming player codec subscription cache blocker adblock popup extension vpn domain dns hosting ip firewall webmaster plugins html5 webgl flash
error errors failed failure unable cannot can't couldn't not unavailable expired denied forbidden disabled enable enabled activate allow turn switch required requires needs need reload refresh retry again invalid timeout timed down maintenance exceeded refused lost reset offline unauthorized unexpected unsupported support wrong busy missing removed deleted blocked unhandled uncaught undefined unreachable unresponsive gone used reached exhausted corrupt corrupted broken aborted crashed rejected forbidden maintenance install upgrade update verify bad nothing no fatal fault segmentation suspended banned restricted refusing refuses overloaded reachable clear verify redirected redirects incompatible dead
the a an this that these your you our we is are was were be been being has have had in on of to for from with by at and or but it its if then now no longer any please sorry oops try later soon back shortly while when before after only do does must will may can could should there here later minutes seconds hours moment temporarily currently permanently found exist exists available loading load loaded view see show shown display displayed continue use using watch content file files video text internal unknown fatal warning bad code status reached limit many too most requested looking out up off log sign in administrator contact support settings try's trying reason due scheduled under moved may under something went has your running run work works properly correctly first open read process processed complete completed respond responding response closed owner today document resource information refer reference id whilst again request requests permission used by today me us code ray id row line index null return back home go start click press tap here ok retry s ms sec wait waiting requests per day daily hour yet still via using every all other another address site link links visit visited page's feed key media option options preferences following correct properly order full features feature application app apps user users human prove that you're aren't isn't doesn't don't didn't hasn't won't that's there's it's we're we'll again once more over within next previous server's time times version old older outdated newer latest supported translation slow so hidden connect connecting connected establish establishing check checking accessing processing process rate country region happened happen got get without went experiencing ad ads may be moved temporarily permanently followed owner's traffic high volume queue position capacity redirect large length size format policy terms area because them these those been from at of its own human verification complete security checks another version prevented prevent supports
página sitio servidor sesión navegador javascript script scripts cookies subtítulos subtítulo pista reproductor solicitud conexión red servicio acceso permiso cuenta base descargas descarga límite servidores cuota limite archivo fichero excepción contraseña usuario sistema mantenimiento ocurrido producido ocurrió produjo vídeo contenido algo problema streaming suscripción formato dirección ip
error errores no imposible caducado caducada expirado expirada denegado denegada prohibido desactivado deshabilitado active activar activa activado habilite habilitar permita requiere necesita necesario recargue recargar actualice inténtelo intente inválido inválida disponible mantenimiento superado perdido perdida fallo falló fallido inesperado ocupado superado excedido agotado alcanzado ningún ninguna responde sobrecargado bloqueado suspendida suspendido restringido compatible
el la los las un una de del al en a su sus este esta para por con y o se ha han sido está están es son que más tarde nuevo por favor lo sentimos ver mostrar cargar cargando continuar usar contenido archivo vídeo video texto interno interna desconocido pudo puede pueden encontrado encontrada existe ocurrido producido solicitada solicitado buscada busca momento momentos minutos pronto volveremos demasiadas datos tiempo espera agotado temporalmente actualmente iniciar sesión código responde cerrado ya hoy ha han haber seguridad usted vuelva volver vuelve intentar intentarlo otra vez minutos horas servicio nos estamos trabajando red del diario diaria día para página ir inicio código ray actívelos debe deben conectar conectarse país salió mal admite puede alcanzar tráfico zona
seite webseite server sitzung browser javascript skript skripte skripten cookies untertitel spur player anfrage anfragen verbindung netzwerk dienst zugriff berechtigung konto datenbank limit tageslimit downloads ausnahme dateien passwort benutzer adresse wartung wartungsarbeiten aufgetreten video inhalt etwas problem streaming abonnement konto webseiten adresse ip
fehler nicht abgelaufen verweigert verboten deaktiviert aktivieren aktiviert einschalten erlauben erforderlich benötigt braucht laden erneut ungültig verfügbar wartung wartungsarbeiten überschritten verloren fehlgeschlagen gescheitert unerwarteter zeitüberschreitung ausgelastet erreicht ausgeschöpft gesperrt nichts antwortet unbekannt wartung unterbrochen überlastet erreichbar unterstützt blockiert gesperrt eingeschränkt
die der das den dem des ein eine einen einem einer diese dieser dieses ihr ihre ihrem ihren sie wir sind ist war wurde werden worden wird hat haben im in auf zu zum zur für von mit bei und oder es um bitte leider später bald wieder noch einmal versuchen sie neu anzeigen angezeigt sehen fortfahren fortzufahren benutzen inhalt datei video text interner interne unbekannter gefunden existiert aufgetreten angeforderte angeforderten gesuchte konnte können kann geladen moment minuten zurück zu viele vorübergehend derzeit melden an code antwortet geschlossen keine kein mehr wegen aufgrund heute täglich tag dann bitte neue neuer seiten diesen dieser uns unsere unserer stunden gleich kommen kehren versuche versuch aus ray gegen während beim müssen muss damit um können sie dürfen man hergestellt herstellen verbinden land schiefgelaufen schief gelaufen ging gegangen versuchen ihre wurde derzeit momentan
page site serveur session navigateur javascript script scripts cookies sous titres titre piste lecteur requête requêtes connexion réseau service accès autorisation compte base limite téléchargements téléchargement chargement serveurs fichier exception quota lien adresse maintenance survenue survenu produite produit vidéo contenu problème abonnement lecteur format adresse ip
erreur erreurs pas impossible introuvable expiré expirée refusé refusée interdit interdite désactivé activer activez activé autoriser autorisez requis nécessaire nécessite exige rechargez recharger actualisez réessayez réessayer invalide indisponible disponible maintenance dépassé dépassée perdue échec échoué inattendue occupé atteinte atteint dépassée répond aucune aucun bloqué bloquée surchargé bloqué suspendu suspendue restreint
le la les l un une de du des d au aux en à votre vos notre nos vous nous ce cet cette pour par avec et ou se s est sont a ont été n ne que plus tard nouveau bientôt veuillez désolé afficher voir charger chargement continuer utiliser contenu fichier vidéo texte interne inconnue peut pu trouvée trouvé trouver existe survenue survenu produite demandée demandé recherchée moment minutes retour trop données délai temporairement actuellement code répond fermé pendant lors puis dans ici aujourd hui jour heure heures ray votre d'erreur l'erreur s'est qu qui cela veuillez essayer essayez fois être avoir été doit devez nous sommes en cours travaux ici utilisateur mot passe connecter doit pays quelque chose mal passé prend charge en ne pas prise actuellement
страница страницу страницы сайт сервер сервера сервером сеанс сеанса сессия браузер браузере javascript скрипт скрипты скриптов cookie субтитры субтитров дорожка дорожки плеер запрос запроса запросов соединение подключение сеть сервис служба доступ доступа лимит загрузок загрузке загрузки загрузка файл файла файлу исключение пароль ссылка адрес обслуживание обслуживания произошла произошел произошло видео проблема подписка формат
ошибка ошибки не невозможно истекло истек истекла запрещён запрещен запрещена отказано отключён отключен отключены включите включить разрешите требуется требуются нужны нужен перезагрузите обновите повторите попробуйте недоступна недоступен недоступно недействителен обслуживание обслуживания превышен превышено потеряно сбой занят превышен превышена исчерпан исчерпано заблокирован заблокирована заблокировано перегружен приостановлен ограничен недоступны
и в на к с по для из от у о или а но ваш ваша ваше вашем ваши мы вы этот эта это этого этой был была было были будет пожалуйста извините позже скоро снова ещё еще раз найдена найден найдено найти существует произошла произошел загрузке загрузки загрузить загрузка показа просмотра увидеть посмотреть продолжить чтобы содержимое файл файла файлу видео текст внутренняя неизвестная удалось может запрошенная запрашиваемая время ожидания минут слишком много данных лимит временно сейчас код отвечает их закрыт технические работы дневной дневная суточный сегодня завтра минут минуту вернитесь попробовать указан неверный неверно мы уже скоро проводятся вас вам нет такой такая этой сайта при что то пошло так сейчас данный
página site servidor sessão navegador javascript script scripts cookies legendas legenda faixa leitor pedido solicitação conexão ligação rede serviço acesso permissão conta limite arquivo ficheiro ligações senha utilizador usuário manutenção ocorreu vídeo conteúdo assinatura formato endereço
erro erros não impossível expirou expirada expirado negado proibido desativado ative ativar ativado habilite permitir necessário requer precisa recarregue recarregar atualize tente inválido indisponível disponível manutenção excedido perdida falha falhou inesperado atingido atingida esgotado esgotada bloqueado sobrecarregado suspensa suspenso restrito
o a os as um uma de do da dos das no na nos nas em ao à seu sua este esta para por com e ou se foi está estão é são que mais tarde novo novamente favor desculpe ver mostrar carregar continuar usar conteúdo arquivo ficheiro vídeo texto interno desconhecido pode encontrada encontrado existe ocorreu solicitada momento minutos breve código responde tempo limite hoje dia diário ray servidores vez tente estamos volte voltar mais nossa nosso você seu sua houve um foi deve país conectar suporta atualmente momento
pagina sito server sessione browser javascript script cookie sottotitoli sottotitolo traccia lettore richiesta richieste connessione rete servizio accesso permesso account limite file password utente manutenzione verificato verificata video contenuto problema qualcosa abbonamento formato indirizzo
errore errori non impossibile scaduta scaduto negato vietato disattivato disabilitato attivare attiva attivate abilita abilitare consentire necessario richiede ricaricare ricarica aggiornare riprova riprovare invalido disponibile manutenzione superato persa fallito fallita imprevisto raggiunto raggiunta esaurito bloccato superata sovraccarico sospeso limitato raggiungibile
il lo la i gli le un uno una di del della dei in nel nella a al alla tuo tua suo sua questo questa per con da e o si è sono stato stata che più tardi nuovo spiacenti vedere visualizzare mostrare caricare continuare usare contenuto file video testo interno sconosciuto può trovata trovato esiste verificato richiesta momento minuti presto codice risponde tempo scaduto oggi giorno giornaliero ray stiamo torna torneremo lavorando prova provare nostro nostra tuoi si prega di nuovamente volta deve connettersi paese andato storto supporta supportato attualmente momento
pagina website server sessie browser javascript script scripts cookies ondertitels ondertiteling speler verzoek verbinding netwerk dienst toegang account limiet bestand wachtwoord gebruiker onderhoud opgetreden video inhoud
fout fouten niet onmogelijk verlopen geweigerd verboden uitgeschakeld schakel activeer inschakelen vereist nodig herlaad vernieuw opnieuw ongeldig beschikbaar onderhoud overschreden verbroken mislukt onverwachte bereikt geblokkeerd
de het een deze dit uw je is zijn was werd worden kan kon heeft in op van te om voor met bij en of er alstublieft sorry later probeer nog eens bekijken tonen laden doorgaan gebruiken inhoud bestand video tekst interne onbekende gevonden bestaat opgetreden gevraagde moment minuten terug code reageert vandaag dag ray onze wij we zijn bezig kom uw aan de
strona strony witryna serwer serwera sesja przeglądarka przeglądarce javascript skrypt skrypty skryptów cookies napisy napisów odtwarzacz żądanie połączenie sieć usługa dostęp konto limit plik hasło użytkownik konserwacja wystąpił
błąd błędy nie nieosiągalny wygasła wygasł zabroniony wyłączony włącz włączyć wymaga wymagane potrzebuje odśwież spróbuj nieprawidłowy niedostępna niedostępny konserwacja przekroczono utracono osiągnięto zablokowany przekroczony
w z na do i o się jest są został została zostało twoja twój ta ten to tej przepraszamy proszę później wkrótce ponownie jeszcze raz obsługę aby zobaczyć wyświetlić kontynuować plik wideo tekst wewnętrzny nieznany znaleziono istnieje wystąpił żądana chwilę minut czas kod odpowiada dzisiaj dziś dzień ray nasza nasz trwa trwają prace wróć wrócimy
"""
# Written for this module: of the technical things and the failures, words of everyday speech; two of them alone are no notice.
EVERYDAY = """
high clear dead domain extension abonnement lecteur suscripción dirección adresse endereço indirizzo подписка formato format assinatura abbonamento compatible refuses refusing restricted
something problem problems issue algo problema etwas problème проблема qualcosa
request requests content video videos encountered inhalt contenu contenido contenuto inhoud conteúdo vídeo vidéo видео no nothing used reached gone bad broken device security token update verify quota's install robot pages link resource resources aborted crashed rejected
descarga usuario sistema alcanzado ningún ninguna agotado password passwords contraseña passwort senha hasło wachtwoord пароль
erreicht nichts adresse benutzer ausnahme
atteint atteinte aucun aucune chargement adresse lien bloqué
лимит загрузок загрузке загрузки загрузка адрес ссылка
utente raggiunto bloccato usuário hoje
bereikt gebruiker użytkownik
page track player connection connections network service access account host stream download upload proxy gateway occurred plugin caption captions subtitle subtitles
not cannot can't couldn't need needs lost again turn switch down wrong busy missing removed deleted blocked refused reset support allow disabled require required requires unexpected unsupported failure failed retry
página sitio pista conexión red servicio acceso permiso cuenta base solicitud no imposible necesita necesario perdido perdida fallo falló fallido permita inesperado ocupado activa
seite spur anfrage anfragen verbindung dienst zugriff berechtigung konto nicht braucht benötigt verloren gescheitert verboten erlauben laden
titre titres sous piste lecteur connexion réseau service accès compte base requête requêtes pas impossible perdue échec échoué nécessaire exige inattendue occupé
страница страницу страницы сеть служба доступ доступа дорожка дорожки соединение запрос запроса запросов не нужны нужен потеряно занят сбой запрещено отказано
pedido solicitação conexão ligação rede serviço acesso permissão conta leitor faixa não impossível preciso precisa perdida falha proibido tente
pagina traccia lettore richiesta richieste connessione rete servizio accesso permesso account sito non impossibile necessario persa vietato
verzoek verbinding netwerk dienst toegang account speler niet onmogelijk nodig fout fouten vereist verboden
strona strony witryna połączenie sieć usługa dostęp konto żądanie nie potrzebuje włącz
"""
# Written for this module: what tells, of a thing, that it is not there.
FOUND = "available disponible verfügbar disponibile dostępna beschikbaar disponível responding respond responde antwortet répond отвечает risponde reageert odpowiada found exist exists encontrada encontrado existe gefunden existiert trouvée trouvé trouver найдена найден найдено существует trovata trovato esiste gevonden bestaat znaleziono istnieje loading load loaded cargar laden geladen charger загрузить caricare carregar"


# Written for this module: words of empty slots: what is to be filled in; what says so; what says so if "here" or the like stands by; what stands around them.
SLOT_WORDS = """
text title subtitle subtitles caption captions dialogue dialog translation line name sentence content headline texto título subtítulo diálogo traducción untertitel übersetzung titel name dialog texte titre sous titre traduction dialogue текст титул название перевод реплика episode series show season speaker translator uploader author date episodio serie temporada fecha traductor autor folge staffel datum übersetzer épisode série saison traducteur auteur серии серия эпизод сезон имя переводчика автор дата
insert sample placeholder todo fixme tbd dummy untranslated xxx missing replace insertar insertad insérer einfügen platzhalter muestra ejemplo marcador вставьте вставить заглушка образец
add enter type put your goes go translate write edit tu su escribe añadir aquí ihr hier eingeben übersetzen votre ici saisir traduire ваш здесь введите переведите
here this the a an of with for please to be by el la de un der die das den le un une этот сюда
"""
# Written for this module: words that say where a slot is.
SLOT_PLACES = "here this aquí hier ici здесь сюда"

# Written for this module: names of status codes, which need their number before or after.
STATUS = re.compile(
    r"^(?:[\W_]|#|https?|error|status|code|fehler|erreur|errore|erro|fout|ошибка|błąd)*(?:bad request|unauthorized|payment required|forbidden|(?:(?:page|file|url|resource) )?not found|method not allowed|not acceptable|proxy authentication required"
    r"|request time-?out|conflict|gone|length required|precondition failed|(?:payload|content|request entity|uri) too (?:large|long)|unsupported media type|range not satisfiable|expectation failed|unprocessable (?:entity|content)|locked|too early"
    r"|upgrade required|too many requests|internal server error|not implemented|bad gateway|(?:service )?(?:temporarily )?unavailable|gateway time-?out|http version not supported|insufficient storage|loop detected|network authentication required)(?:[\W_]|#|error)*$", re.I
)
# Written for this module: the request to come back, which tells of a notice where nothing else does.
TRY_LATER = re.compile(r"\b(?:try|retry|check|come|inténtelo|intente|inténtalo|versuchen|versuche|réessayez|réessayer|попробуйте|повторите|riprova|riprovare|tente|probeer|spróbuj)\b.*\b(?:later|shortly|soon|más tarde|später|plus tard|позже|più tardi|mais tarde|później)\b", re.I)
# Written for this module: what programs print in place of a text.
LITERAL = re.compile(r"\W*(?:undefined|null|nan|\[object \w+\])\W*", re.I)
READ_AS_LETTERS = str.maketrans({"0": "o", "1": "l", "|": "l", "5": "s"})
# Written for this module: names of code in a message, and words of its failures.
CODE = re.compile(r"\b\w+\.(?:php|js|py|jsp|aspx?|rb|cgi|dll|java|c|cpp|html?)\b|\b\w+\(\)|\b\w+(?:Exception|Error)\b|\bat line #|\bon line #|\bstack ?trace\b|\btraceback\b|\b0x[0-9a-f#]+", re.I)
CODE_HINT = re.compile(r"\.\w|\(\)|xception|rror|line #|stack|trace|0x|STACK|TRACE|XCEPTION|RROR|LINE #|Stack|Trace")
CODE_FAILURE = re.compile(r"\b(?:unhandled|uncaught|traceback|fatal|undefined|warning|segmentation|syntax|parse|runtime|deprecated|stack|failed)\b|exception|error", re.I)

#: Neighbouring cues that are judged together at most.
SPREAD = 6
#: A message recurs widely from so many documents and sources on, and if it stands in one of WIDE_SHARE documents.
WIDE_DOCUMENTS, WIDE_SOURCES, WIDE_SHARE = 5, 3, 5000
#: Kind of a message that is no residue by itself but may be a part of a notice.
PART = "part"

# Written for this module: forms of placeholders that need no known name. Masked numbers are #.
PLACEHOLDER = re.compile(
    r"\{\{[^{}]{1,60}\}\}|\$\{[^{}]{1,60}\}|<%.{1,60}?%>|\{%.{1,60}?%\}|@@[\w. ]+@@|##\s?[^\W\d][\w. ]*##|\b__[A-Z][A-Z0-9_]*__"
    r"|%[A-Z][A-Z_]{2,}%|%#\$[sd]|(?<![\\\w])\{#\}|<[A-Z]+(?:_[A-Z]+)*>|\[[Il1]NSERT [^\[\]]+\]|\[[Yy](?:our|OUR) [^\[\]]+\]|\[\[\s?[\w. |-]+\]\]|\[(?:[A-Z][a-z]+ )+(?:Name|Title|Date|Email|Address|Number|Text)\]"
)
MARKUP_NAMES = frozenset("HTML HEAD BODY TITLE META LINK DIV SPAN FONT STYLE SCRIPT TABLE CENTER STRONG".split())
BRACKETED = re.compile(r"\{([^{}\\]{3,40})\}|<([^<>/%]{3,40})>|\[([^\[\]]{3,40})\]|\(\(\(([^()]{3,40})\)\)\)|\*([^*]{3,40})\*")
PAGE = re.compile(r"<!doctype html|<html\b|<noscript\b|^\W*\{\s*\"(?:status|error|code)\"\s*:", re.I)
MARKS = re.compile(r"[{$<%@_\[*]|\(\(\(|##")
# Written for this module: what services put behind a message: a number in brackets, an id.
TAIL = re.compile(r"(?:\s*\([^()]*#[^()]*\)|\s*\[[^\[\]]*#[^\[\]]*\]|[\s.]*\b(?:ray|ref|reference|request|trace|incident)(?: id)?[ :#]+)[\s.]*$", re.I)
# Written for this module: what services put before a message: an exclamation, the name of a program or header.
LEAD = re.compile(r"^\W*(?:(?:sorry|oops|whoops|uh-oh|lo sentimos|ups|hoppla|désolé|извините|упс)\b[\s.!,:…-]*|[a-z][\w-]*(?: [a-z][\w-]*)?: )+", re.I)
ADDRESS = re.compile(r"(?:https?://|www\.)[^\s{}<>%@]+|(?<![^\s<(])[^\s@]+@[^\s@]+\.\w+")
NUMBER = re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b|(?<![^\W_])\d+(?:[-./:]\d+)*(?![^\W_])", re.I)
BLANKS = re.compile(r"[ \t\n\r\f\v\u00a0]+")
# Written for this module: what a wrong encoding makes of a short word.
LOST_WORD = re.compile("[\u00c2\u00c3\u00e2][\u0080-\u00bf]?")
LOST_LETTER = re.compile(r"(?<=[^\W\d_])[?\ufffd](?=[^\W\d_])")
# Written for this module: letters that character recognition takes for one another, after lower-casing.
ALIKE = str.maketrans({"i": "l", "1": "l", "|": "l", "0": "o", "5": "s", "f": "t", "e": "c", "q": "g", "ё": "е"})
# Written for this module: marks of texts read in a wrong encoding, with (read as, written in) to undo it.
MISREAD = (
    (re.compile("[ÐÑÃÂâ]"), (("cp1252", "utf-8"), ("latin-1", "utf-8"))),
    (re.compile("[\u2500-\u259f]"), (("cp866", "cp1251"),)),
    (re.compile("[À-ÿ]"), (("latin-1", "cp1251"), ("cp1252", "cp1251"))),
)
CYRILLIC = re.compile("[а-яА-Я]{3}")



def cues(text: Column) -> Column:
    """The bodies of a text's cues, or its blocks, in order."""
    lines = F.translate(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), "\r", "\n")
    return F.split(F.regexp_replace(lines, LAYOUT, ""), CUE_HEAD)


def masked(message: str) -> str:
    """A message on one line, with addresses as <url> and numbers, dates and ids as #, without marks that stand for a lost letter."""
    if "www." in message or "://" in message or "@" in message:
        message = ADDRESS.sub("<url>", message)
    if "?" in message or "\ufffd" in message:
        message = LOST_LETTER.sub("", message)
    return BLANKS.sub(" ", NUMBER.sub("#", message)).strip()


def repairs(text: str) -> list[str]:
    """What a misread text was before, by its likely wrong encodings, applied once or twice."""
    found = []
    for marks, ways in MISREAD:
        if not marks.search(text):
            continue
        for read_as, written_in in ways:
            once = text
            for _ in range(2):
                try:
                    once = once.encode(read_as).decode(written_in)
                except UnicodeError:
                    break
                found.append(once)
    return found


def folded(text: str) -> str:
    """Letters alone, without case and the differences that character recognition blurs."""
    return re.sub(r"[\W\d_]", "", text.lower().translate(ALIKE)).replace("rn", "m").replace("ll", "h")


def skeleton(text: str) -> str:
    """The letters a-z of a text, alike whether its other letters stand, are lost or were read in a wrong encoding."""
    return re.sub(r"[^a-z]", "", text.lower().translate(ALIKE)).replace("rn", "m").replace("ll", "h")


def grouped_as(message: str) -> str:
    """The form in which messages are counted together: letters, marks and all that is not ASCII, alike in case and misreadings, without what services put around."""
    return re.sub(r"[\x00-\x7f](?<![\w{}<>%$@*\[\]])|(?<![{%$])\d", "", TAIL.sub("", message).lower().translate(ALIKE)).replace("rn", "m").replace("ll", "h")


def slips(word: str) -> list[str]:
    """The word and what is left of it without any one letter."""
    return [word, *(word[:i] + word[i + 1 :] for i in range(len(word)))]


def _listed(block: str) -> list[str]:
    return [x.strip() for x in block.replace("\n", "|").split("|") if x.strip()]


# Kinds of words, added up.
THING, FAILURE, AROUND, COMMON, THERE, SLOT, FILL, MAY_FILL, SLOT_AROUND, PLACE, FILLER, LONG_FILLER = (1 << i for i in range(12))
NOTICE = THING | FAILURE | AROUND
IN_SLOT = SLOT | FILL | MAY_FILL | SLOT_AROUND


class Rules:
    """The fixed values in the form they are compared in: words by their letters, alike in case, misreadings and lost accents."""

    #: Words of so many letters may have one slip.
    SLIP = 6

    def __init__(self):
        self.words: dict[str, int] = {}
        #: Words as they are written come first: read as their letters, some are alike ('file' and 'the').
        self.written: dict[str, int] = {}

        def add(words: str, kind: int) -> None:
            for word in words.split():
                self.written[word.lower()] = self.written.get(word.lower(), 0) | kind
                if key := self._word(word):
                    self.words[key] = self.words.get(key, 0) | kind

        for no, line in enumerate(_listed(NOTICE_WORDS)):
            add(line, (THING, FAILURE, AROUND)[no % 3])
        for line, kind in zip(_listed(SLOT_WORDS), (SLOT, FILL, MAY_FILL, SLOT_AROUND)):
            add(line, kind)
        add(EVERYDAY, COMMON)
        add(FOUND, THERE)
        add(SLOT_PLACES, PLACE)
        add(FILLER_WORDS, FILLER)
        add(" ".join(w for w in (FILLER_WORDS + MORE_FILLER).split() if len(w) >= 4), LONG_FILLER)
        self.near: dict[str, int] = {}
        for word, kind in self.words.items():
            for form in slips(word) if len(word) >= self.SLIP else ():
                self.near[form] = self.near.get(form, 0) | kind
        self.compounds = tuple(self._word(w) for w in "server seite seiten datei dienst limit fehler verbindung sitzung browser".split())
        self.kinds: dict[str, int] = {}
        self.tokens: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def _word(word: str) -> str:
        return folded(word) if CYRILLIC.search(word) or not re.search("[a-zA-Z]", word) else skeleton(word)

    def word_kind(self, word: str) -> int:
        known = self.kinds.get(word)
        if known is None:
            if len(self.kinds) >= 300_000:
                self.kinds.clear()
            known = self.kinds[word] = self._kind_of(word)
        return known

    def _kind_of(self, word: str) -> int:
        if word == "I":
            return 0
        if kind := self.written.get(word.lower(), 0):
            return kind
        key = self._word(word)
        kind = self.words.get(key, 0)
        if not kind and "'" in word:
            halves = [self.word_kind(x) for x in word.split("'") if x]
            kind = AROUND if halves and all(h & NOTICE for h in halves) else 0
        if not kind and len(key) >= self.SLIP:
            for form in slips(key):
                kind |= self.near.get(form, 0)
            if not kind and len(key) >= 9 and key.endswith(self.compounds):
                kind = THING
        return kind

    def word_kinds(self, message: str, spare: int = 6) -> list[int] | None:
        """The kinds of a message's words, or null once more than one in ``spare`` is of no kind."""
        kinds, unknown = [], 0
        parts = message.replace("<url>", " ").split() if "<url>" in message else message.split()
        most, tokens = len(parts) // spare, self.tokens
        for word in parts:
            some = tokens.get(word)
            if some is None:
                some = self._token(word)
            for kind in some:
                if not kind:
                    unknown += 1
                    if unknown > most:
                        return None
                kinds.append(kind)
        return kinds

    def _token(self, token: str) -> tuple[int, ...]:
        """The kinds of the words in what stands between two blanks."""
        pieces = (token,) if token.isalpha() else PIECES.split(token)
        out = tuple(self.word_kind(x.replace("’", "'").strip("'")) for x in pieces if any(map(str.isalpha, x)) and not LOST_WORD.fullmatch(x))
        if len(self.tokens) >= 300_000:
            self.tokens.clear()
        self.tokens[token] = out
        return out

    def _bare(self, message: str) -> list[int]:
        """The kinds of the words of a message, digits within them read as letters."""
        return [self.word_kind(w) for x in message.split() if (w := re.sub(r"^[^\w|]+|[^\w|]+$", "", x))]

    def is_notice(self, message: str, wide: bool = False) -> bool:
        """Whether a message names a technical thing and a failure or request in words of notices.

        wide: whether it recurs widely, so that one word in six may be any.
        """
        if "#" in message and STATUS.match(TAIL.sub("", message)):
            return True
        if message.endswith("?"):
            return False
        kinds = self.word_kinds(message)
        if not kinds or len(kinds) < 2 or not wide and not all(k & NOTICE for k in kinds):
            return False
        core = [k & (THING | FAILURE) for k in kinds]
        either, things, failures = core.count(THING | FAILURE), core.count(THING), core.count(FAILURE)
        if things + either == 0 or failures + either == 0 or things + failures + either < 2:
            return False
        return TRY_LATER.search(message) is not None and len(kinds) >= 5 or any(k & THERE or c and not k & COMMON for k, c in zip(kinds, core))

    def is_slot(self, message: str) -> bool:
        """Whether a message has only words of empty slots and says that something is to be filled in."""
        kinds = self._bare(message)
        if not kinds or len(kinds) > 8 or message.endswith("?") or not all(k & IN_SLOT for k in kinds):
            return False
        slots, fills, may_fill, places = (sum(bool(k & x) for k in kinds) for x in (SLOT, FILL, MAY_FILL, PLACE))
        if len(kinds) == 1:
            return bool(kinds[0] & FILL) and skeleton(message) in ("placcholdcr", "todo", "ixmc", "untranslatcd", "tixmc")
        return fills > 0 and slots + may_fill > 0 or may_fill > 0 and slots > 0 and places > 0

    def is_filler(self, message: str) -> bool:
        """Whether all words of a text are filler, three or more, or seven in ten are and five different ones of four or more letters among them."""
        words = message.split()
        if len(words) < 3:
            return False
        if not any(k & (FILLER | LONG_FILLER) for w in words[:3] for k in self.tokens.get(w) or self._token(w)):
            return False
        words = [w for x in words if (w := re.sub(r"^\W+|\W+$", "", x))]
        kinds = [self.word_kind(w) for w in words]
        if len(kinds) >= 3 and all(k & (FILLER | LONG_FILLER) for k in kinds) and any(k & LONG_FILLER for k in kinds):
            return True
        long = {w.lower() for w, k in zip(words, kinds) if k & LONG_FILLER}
        return 10 * sum(bool(k & (FILLER | LONG_FILLER)) for k in kinds) >= 7 * len(kinds) and len(long) >= 5

    def is_field(self, text: str) -> bool:
        """Whether a bracketed text is the name of a field of a template: words joined by _, or two and more words of slots."""
        for way in (text, *repairs(text)):
            if re.fullmatch(r"\s?[^\W\d_]+(?:_[^\W\d_]+)+\s?", way.translate(READ_AS_LETTERS)):
                return True
            kinds = self._bare(way)
            if len(kinds) > 1 and (self.is_slot(way) or all(k & SLOT for k in kinds)):
                return True
        return False

    def holds_placeholder(self, message: str) -> bool:
        for hit in PLACEHOLDER.finditer(message):
            if hit[0].strip("<>") not in MARKUP_NAMES or "</" not in message:
                return True
        return any(self.is_field(next(x for x in hit.groups() if x is not None)) for hit in BRACKETED.finditer(message))

    def read_again(self, message: str) -> list[str]:
        """What a message in a wrong encoding may have been."""
        return [] if message.isascii() or CYRILLIC.search(message) else [x for x in repairs(message) if CYRILLIC.search(x) or len(x) < len(message)]

    def kind(self, message: str, wide: bool = False) -> str | None:
        """'placeholder', 'page', 'code', 'filler' or 'notice' for a message in place of content, else null."""
        if MARKS.search(message):
            if self.holds_placeholder(message):
                return "placeholder"
            if PAGE.search(message):
                return "page"
        if LITERAL.fullmatch(message.translate(READ_AS_LETTERS)) or self.is_slot(message):
            return "placeholder"
        if self.is_filler(message):
            return "filler"
        if CODE.search(message) and CODE_FAILURE.search(message) and not message.endswith("?"):
            return "code"
        bare = TAIL.sub("", message)
        for text in dict.fromkeys((message, bare, LEAD.sub("", bare), *self.read_again(message), *self.read_again(LEAD.sub("", bare)))):
            if text and self.is_notice(text, wide):
                return "notice"
        return None

    def is_part(self, message: str) -> bool:
        """Whether a message may be a part of a notice: it has only words of notices."""
        for text in (message, *self.read_again(message)):
            kinds = self.word_kinds(text)
            if kinds and all(k & NOTICE for k in kinds):
                return True
        return False

    def seen(self, message: str) -> bool | None:
        """Whether a message could be residue, by itself or with its neighbours (null); without any of the costlier tests for most dialogue."""
        message = masked(message) if TO_MASK.search(message) else message
        first = self.word_kinds(message)
        if first is None and (":" in message or "!" in message or message[:5].lower() == "sorry"):
            first = self.word_kinds(LEAD.sub("", message))
        if first is None and len(message) < 40 and LITERAL.fullmatch(message.translate(READ_AS_LETTERS)):
            return True
        if first is None and not (MARKS.search(message) or CODE_HINT.search(message) and CODE.search(message) or not message.isascii() and BEYOND.search(message)):
            return self.is_filler(message)
        if self.kind(masked(message), True):
            return True
        return None if self.is_part(masked(message)) else False


TO_MASK = re.compile("[0-9?@\ufffd]|www[.]")
PIECES = re.compile(r"[-/—–:;,.!?\"«»“”()\[\]#]+")
# Written for this module: letters of which three in a row tell of a wrong encoding.
BEYOND = re.compile("[\u0080-\u00ff\u2500-\u259f\u0152-\u0178\u2013-\u2122]{2}|\u00d0|\u00d1")


def _rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each document's cues those that could be residue, and those that could be with a neighbour."""
    rules, known = Rules(), {}
    for frame in frames:
        rows = []
        for doc, source, row, parts in zip(frame["doc_id"].tolist(), frame["source"].tolist(), frame["row"].tolist(), frame["cues"].tolist()):
            # a number alone is a cue's own number and stands between no cues
            bodies = [x for part in parts if (x := part.strip()) and not x.isdigit()]
            found = []
            for at, body in enumerate(bodies):
                could = known.get(body, 0)
                if could == 0:
                    if len(known) >= 200_000:
                        known.clear()
                    could = known[body] = rules.seen(body)
                if could is not False:
                    found.append((at, body, could))
            places = {at for at, _, _ in found}
            once = set()
            for at, body, could in found:
                if could or at - 1 in places or at + 1 in places:
                    message = masked(body)
                    group = grouped_as(message)
                    rows.append((doc, source, row, at, message, group, int(group not in once)))
                    once.add(group)
        yield pd.DataFrame(rows, columns=["doc_id", "source", "row", "at", "message", "group", "n"])


def _classified(least: int):
    def classify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules = Rules()
        for frame in frames:
            kinds = []
            for message, n, sources in zip(frame["message"], frame["n_documents"], frame["n_sources"]):
                kind = rules.kind(message, n >= least and sources >= WIDE_SOURCES)
                kinds.append(kind or (PART if rules.is_part(message) else None))
            yield frame.assign(kind=kinds)[[k is not None for k in kinds]]

    return classify


def _runs(parts: list[tuple[int, str]]) -> list[str]:
    """Two to SPREAD parts whose places follow one another, as one message each."""
    out = []
    for first in range(len(parts)):
        for n in range(2, SPREAD + 1):
            some = parts[first : first + n]
            if len(some) < n or some[-1][0] - some[0][0] != n - 1:
                break
            out.append(" ".join(m for _, m in some))
    return out


def _spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rules, known = Rules(), {}
    for frame in frames:
        rows = []
        for doc, source, found, parts in zip(frame["doc_id"].tolist(), frame["source"].tolist(), frame["found"].tolist(), frame["parts"]):
            for text in dict.fromkeys(_runs([(p["at"], p["message"]) for p in parts])):
                if text not in known:
                    if len(known) >= 100_000:
                        known.clear()
                    known[text] = rules.kind(text)
                if known[text]:
                    rows.append((doc, source, text, known[text]))
            if found:
                rows.append((doc, source, None, None))
        yield pd.DataFrame(rows, columns=["doc_id", "source", "message", "kind"])


def _hashed(rows: DataFrame, of: str) -> DataFrame:
    return rows.withColumn("hash_a", F.xxhash64(of)).withColumn("hash_b", F.xxhash64(F.lit("residue"), of))


HASH = ["hash_a", "hash_b"]


def candidates(documents: DataFrame) -> DataFrame:
    """(doc_id, source, row, at, message, n, hash_a, hash_b) of the messages that could be residue, from one scan of the texts."""
    kinds = dict(documents.dtypes)
    split = documents.select("doc_id", "source", F.monotonically_increasing_id().alias("row"), cues(F.col("text")).alias("cues")).where("size(cues) > 0")
    rows = split.mapInPandas(_rows, f"doc_id {kinds['doc_id']}, source {kinds['source']}, row long, at int, message string, group string, n long")
    return cut(_hashed(rows, "group").drop("group"))


def judged(held: DataFrame, document_count: int) -> DataFrame:
    """(hash_a, hash_b, message, n_documents, n_sources, kind) of the groups of messages that are residue or parts of a notice.

    Messages are first counted per source and then over sources, so none is gathered in one place.
    """
    per_source = held.groupBy(*HASH, "source").agg(F.sum("n").alias("n"), F.min("message").alias("message"))
    grouped = per_source.groupBy(*HASH).agg(F.min("message").alias("message"), F.sum("n").alias("n_documents"), F.count("*").alias("n_sources"))
    return grouped.mapInPandas(_classified(max(WIDE_DOCUMENTS, document_count // WIDE_SHARE)), "hash_a long, hash_b long, message string, n_documents long, n_sources long, kind string")


def _found(held: DataFrame, groups: DataFrame) -> DataFrame:
    """(doc_id, source, message, kind): a row of nulls for documents with residue in one cue, and the messages spread over several."""
    known = groups.select(*HASH, (F.col("kind") != PART).alias("whole"))
    parts = F.array_sort(F.collect_list(F.when(~F.col("whole"), F.struct("at", "message"))))
    hits = spread_join(held, known, HASH).groupBy("doc_id", "source", "row").agg(F.max("whole").alias("found"), parts.alias("parts"))
    kinds = dict(held.dtypes)
    return hits.where("found OR size(parts) > 1").mapInPandas(_spread, f"doc_id {kinds['doc_id']}, source {kinds['source']}, message string, kind string")


def recurring(documents: DataFrame) -> DataFrame:
    """Every message found to be residue: message, kind, n_documents, n_sources and its two hashes; those spread over cues too.

    Messages that differ only in case, misreadings or what services put around them are one, named by the least of them.
    """
    held = candidates(documents)
    groups = cut(judged(held, documents.count()))
    over = _found(held, groups).where("message IS NOT NULL").groupBy("message", "kind", "source").agg(F.count("*").alias("n"))
    over = _hashed(over.groupBy("message", "kind").agg(F.sum("n").alias("n_documents"), F.count("*").alias("n_sources")), "message")
    whole = groups.where(F.col("kind") != PART)
    return whole.unionByName(over.join(whole.select("message"), "message", "left_anti"))


def residue_documents(documents: DataFrame) -> DataFrame:
    """doc_id of every document with residue, each once.

    documents: doc_id, text, source; null, empty and blank texts have no messages and are never found; a
    null source is a source of its own; rows with the same doc_id count as one document. Other columns
    play no part.
    """
    held = candidates(documents)
    return _found(held, judged(held, documents.count())).select("doc_id").distinct()
