"""Residue rules on messages that stand nowhere in the test tables: wordings of common servers, players, templates and frameworks.

RESIDUE and DIALOGUE were written before the rules were first run on them (58 of 85 found, no dialogue); the
rules were then extended by kinds of words that were missing. UNSEEN and SPOKEN were written after that (19 of 30, no
dialogue), and the vocabulary was extended again. LAST and SAID were written after that and changed nothing.
"""

from termweave.llm.residue import Rules, masked

RESIDUE = """
Access denied.
You need to enable JavaScript to run this app.
JavaScript must be enabled to view this page
The requested URL was not found on this server.
# Page not found
Something went wrong. Please try again later.
Error establishing a database connection
[Your Name]
[Company Name]
[[title]]
An unexpected error occurred while processing your request.
503 Service Temporarily Unavailable
HTTP Error 404. The requested resource is not found.
This site can't be reached
Your connection was reset
The server encountered an internal error and was unable to complete your request.
Unable to connect to the database server.
The page you requested could not be found.
Sorry, this video is not available.
This content is not available in your country
Session timed out. Please sign in again.
Your browser is not supported. Please upgrade to the latest version.
Cookies are disabled in your browser. Please enable cookies to continue.
Please turn on JavaScript and reload the page.
Checking your browser before accessing the site.
Service unavailable due to maintenance.
The website is under maintenance. Please check back soon.
429 Too Many Requests
Rate limit exceeded. Try again in 30 seconds.
API quota exceeded
Invalid access token
Failed to load resource
Request failed with status code 500
Uncaught TypeError: undefined is not a function
NullPointerException at Player.java:88
Traceback (most recent call last): File "main.py", line 3
Fatal error: Uncaught exception in /var/www/index.php on line 12
Notice: Undefined variable: title in header.php on line 7
Segmentation fault at 0x0042
SyntaxError: Unexpected token < in JSON at line 1
{{user.name}}
Presented by @@episode.no@@
Find it at http://{{site}}/list
${episode_title}
%TITLE%
<%= subtitle %>
{% block content %}
__PLACEHOLDER__
Hello [your city]
Dear {{first_name}}, welcome
Insert text here
Enter your title here
Placeholder text
TODO: add translation
Dummy text
Lorem ipsum dolor sit amet, consectetur adipiscing elit.
Ut enim ad minim veniam, quis nostrud exercitation
Duis aute irure dolor in reprehenderit
NaN
[object HTMLDivElement]
undefined
Seite nicht gefunden
Ein unbekannter Fehler ist aufgetreten.
Die Verbindung zum Server wurde unterbrochen
Bitte aktivieren Sie Cookies in Ihrem Browser
Zugriff verweigert
La page demandée est introuvable
Une erreur est survenue, veuillez réessayer plus tard.
Accès interdit
Le serveur ne répond pas
Pagina non trovata
Si è verificato un errore. Riprova più tardi.
Abilita JavaScript nel browser per continuare
La página solicitada no existe
Error de conexión con la base de datos
Debe habilitar JavaScript para continuar
Página não encontrada
Ocorreu um erro inesperado
Ative o JavaScript no seu navegador
Страница не существует
Произошла ошибка сервера, попробуйте позже
Доступ запрещён
De pagina is niet gevonden
Er is een fout opgetreden, probeer het later opnieuw
Strona nie została znaleziona
Wystąpił błąd serwera
ページが見つかりません
""".strip().split("\n")

DIALOGUE = """
I lost my page in the book.
The waiter dropped the tray again.
Turn the page, please.
She never found the door.
There was an error in the bill, so I did not pay.
My son plays a server in that game.
He said the connection between them was lost long ago.
The captain denied everything.
Access to the roof is through the kitchen.
I need the script by tomorrow.
This script is a mess, we need another writer.
Your session with the doctor is at four.
The browser at the bookshop bought nothing.
Please try the soup.
Nothing here works any more.
You have to log the hours.
They were not found guilty.
Not found guilty?
Is the server down?
My name is null and void to him.
He printed an undefined shape on the wall.
(phone rings)
[DOOR CREAKS]
[Maria sighs]
<i>Where were you?</i>
*coughs*
Your name here means nothing.
I put the text in the drawer.
Say your line!
We are closed today.
Come back later.
Who removed the file from my desk?
The account of the journey was long.
Network of spies? Here?
{\\an8}Good evening, sir.
That costs $5, or 100%.
Dolor. That is Spanish for pain.
Sit, Rex, sit!
Et in Arcadia ego.
Die Seite ist leer, sagte er.
Das war ein Fehler, mein Freund.
La page est tournée, mon ami.
C'est une erreur de jeunesse.
Fue un error venir aquí.
Это была ошибка, сказал он.
""".strip().split("\n")

UNSEEN = """
Error 522: connection timed out
The proxy server is refusing connections
Please update your browser to view this site.
Account suspended
404: the link you followed may be broken
Your IP address has been blocked.
Login required
File not found
Could not connect to server
Network error. Check your connection and retry.
Streaming service is currently unavailable.
This page requires JavaScript.
Scripts are disabled. Enable them to watch the video.
Bad request
401 Unauthorized
Unable to load subtitles. Please refresh the page.
#define ERROR undefined at build.py line 14
{{ episode.name | upper }}
$(TITLE)
<<SPEAKER>>
[Insert Name]
Sample text
Add your text here
Excepteur sint occaecat cupidatat non proident
Diese Webseite ist nicht erreichbar
Der Server ist überlastet. Versuchen Sie es später erneut.
Votre navigateur ne prend pas en charge JavaScript
Servicio no disponible
El servidor ha encontrado un error interno
Сервис временно недоступен
""".strip().split("\n")

SPOKEN = """
I can't connect with you any more.
The judge suspended the trial.
They blocked the road to the village.
Check your pockets, boy.
Nobody refreshed the flowers.
The link in the chain is broken.
You must enable him to learn.
Is this seat available?
The captain is unavailable, madam.
Her account of the night was wrong.
Mein Browser? Was soll das sein?
Le serveur a renversé la soupe.
El camarero no responde, señor.
Try again, my love.
We request the pleasure of your company.
""".strip().split("\n")


LAST = """
Playback error. Reload the player.
This domain has expired
Video unavailable
Connection refused by host
We are experiencing technical problems. Please come back later.
Subscription required to view this content
Please disable your ad blocker to continue.
Verify you are human to continue
The requested page has been moved permanently.
Invalid request method
Unable to decode video: codec not supported
Token expired. Sign in again to continue watching.
System.NullReferenceException: object reference not set
Warning: mysqli_connect(): access denied for user in db.php on line 9
{{ t('greeting') }}
%%EPISODE_NAME%%
<INSERT TITLE>
Translation goes here
Add caption text here
Sed ut perspiciatis unde omnis iste natus error sit voluptatem
Ungültige Anfrage
Ihr Konto wurde gesperrt. Bitte wenden Sie sich an den Administrator.
Service indisponible pour le moment
El navegador no es compatible con este reproductor
Сервер перегружен, попробуйте позже
""".strip().split("\n")

SAID = """
The domain of the king was wide.
Clear the table, please.
We refuse to pay.
The traffic was high that day.
He moved permanently to Lisbon.
They suspended the service at the church.
It was a dead page in his life.
Verify it yourself, professor.
Das Konto ist leer, mein Lieber.
Je ne prends pas en charge vos dettes.
""".strip().split("\n")


def test_share_of_unseen_messages_found():
    rules = Rules()
    missed = [m for m in RESIDUE if not rules.kind(masked(m))]
    wrong = [m for m in DIALOGUE if rules.kind(masked(m))]
    assert len(RESIDUE) >= 60 and len(missed) <= len(RESIDUE) // 10, missed
    assert len(wrong) <= 2, wrong


def test_no_message_that_is_judged_residue_is_dropped_in_the_scan():
    rules = Rules()
    assert all(rules.seen(m) for m in RESIDUE if rules.kind(masked(m)))


def test_a_wide_message_may_hold_a_word_of_its_own():
    rules = Rules()
    message = "The download server of Zorbtube is temporarily unavailable"
    assert rules.kind(message) is None and rules.kind(message, wide=True) == "notice"


def test_messages_the_rules_were_not_extended_by():
    rules = Rules()
    missed = [m for m in LAST if not rules.kind(masked(m))]
    wrong = [m for m in SPOKEN + SAID if rules.kind(masked(m))]
    print(len(missed), len(LAST), missed, wrong, [m for m in UNSEEN if not rules.kind(masked(m))])
    assert len(missed) <= len(LAST) * 4 // 10 and len(wrong) <= 2
