"""Labelled everyday texts, written before the grammars of ``ruleframe.llm.residue`` and without the test documents.

``SEEN_*`` may be looked at while the grammars are written; ``HELD_*`` only measure them.
"""

SEEN_RESIDUE = [
    "Just a moment... Checking if the site connection is secure", "Por favor, habilite JavaScript para ver esta página.", "Página no encontrada", "404 - File or directory not found.", "Dear [Your Name],", "Dear <Customer Name>, your order", "Dear %FIRSTNAME%, hello", "Hello :name:, welcome",
    "Access to this page has been denied because we believe you are using automation tools", "You are being redirected...", "Warning: mysql_connect(): Access denied for user", "Fatal error: Uncaught exception in /var/www/html/index.php", "Content coming soon.", "undefined undefined undefined", "Vous devez activer JavaScript",
    "The page you requested was not found.", "500 Internal Server Error nginx", "DNS_PROBE_FINISHED_NXDOMAIN", "Sorry, you have been blocked", "{first name}", "Please enable JavaScript to continue.", "Error 521: Web server is down", "Hi {{first_name}}, thanks for your order", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.",
    "Attention Required! | Cloudflare", "JavaScript is disabled in your browser.", "[Insert company name here]", "${user}",
    "Your order {order_id} has shipped to {shipping_address}.", "Dear {{customer.name}},\n\nYour invoice of {{invoice.date | date}} is due.", "Thank you for calling [COMPANY_NAME], how can I help?", "Bonjour %(prenom)s, votre commande est prête.", "Sehr geehrte/r #{nachname}, Ihr Termin ist bestätigt.",
    "The bakery opened in 1952.\n\nTODO: [add photo here]\n\nIt sells rye bread.", "Best hotels in [[CITY]] for families.", "Published on <%= post.date %> by the team.", "java.lang.NullPointerException: null\n\tat com.shop.Cart.total(Cart.java:42)", "Traceback (most recent call last):\n  File \"app.py\", line 3, in <module>",
    "HTTP Status 404 – Not Found", "Error establishing a database connection", "This site can’t be reached", "Your connection was interrupted", "ERR_CONNECTION_TIMED_OUT", "Bad Request - Invalid Hostname", "Whoops, looks like something went wrong.", "Die Seite wurde nicht gefunden.", "Oops! That page can’t be found.",
    "La page que vous recherchez n'existe pas.", "Pagina non trovata", "Pagina niet gevonden", "Zugriff verweigert", "Seite nicht verfügbar", "Diese Webseite benötigt JavaScript.", "JavaScript must be enabled in order for you to use this site.", "Cookies must be enabled to log in.", "Your browser is not supported. Please upgrade your browser.",
    "Verifying you are human. This may take a few seconds.", "Please complete the security check to access the site.", "Text goes here", "This is a sample text. Replace it with your own.", "Hier könnte Ihr Text stehen. Platzhaltertext.", "xxx xxxx xxxxx xx xxxx", "test test test test test",
]
SEEN_CLEAN = [
    "See [[Paris]] and [[London]] for details of the treaty.", "The <HTML> element is the root of a page.", "Let {x} be a singleton set and {y} another.", "Members of [NATO] met in Brussels.", "He works for [IBM], she for [BBC].", "In Python use __INIT__ carefully", "We use jinja: {{ name }} prints the name. For example {{ x }} and {{ y }}.",
    "The server brought us the menu and we ordered fish.", "He denied access to the archive for years.", "The page was torn out of the book and never found.", "I could not find the page he quoted.", "Our service is at ten on Sundays.", "The session was closed at noon by the chair.", "She scripted the play in 1951 and the scripts are in the archive.",
    "The bridge was closed after the flood of 1998.", "In 404 the emperor moved his court to Ravenna.", "Flight 502 was delayed by fog.", "There were 403 delegates and 500 guests.", "Enable JavaScript only on pages you trust, the guide tells its readers.", "Many visitors complained that they saw error 404 all day.", "Cookies and tea will be served after the talk.",
    "“Page not found” is the title of her new novel.", "The road was blocked, so we turned around.", "Use `{{ user }}` in the template to print the name.", "```\n<p>{{ title }}</p>\n```\nshows the title.", "The set {a, b, c} has eight subsets.", "The function f(x) = x^2 maps {1, 2} to {1, 4}.", "He wrote [sic] on the margin.", "The vote was 12 to 3 [applause].",
    "Prices rose 5% and wages 3% in May.", "Write to info@example.org or call 555-0100.", "a <- b means that a takes the value of b", "Use <b> for bold text and <i> for italics.", "The variable $name holds the user's name.", "The film “Lorem Ipsum” opened the festival.", "No, no, no! she cried.", "Hear, hear, hear!", "Row, row, row your boat.",
    "The clerk said the record was unavailable for two days.", "The committee cannot be reached by telephone on Fridays.", "My request was denied by the council last year.", "The connection between Bonn and Berlin was closed in 1994.", "Our host was not at home.", "Access to clean water is denied to millions.", "An error occurred in the count of the votes, the returning officer admitted.",
    "Sie sagte, die Seite sei nicht gefunden worden.", "Le serveur nous a apporté la carte.", "La sesión fue cerrada por el presidente.", "The website of the museum describes how visitors can enable captions in their browser.", "Type %PATH% in the console to print the search path.", "I am sorry, but I must object.", "Sorry is the hardest word.", "This book is a sample of his work.",
]
HELD_RESIDUE = [
    "Dear [First Name],\nThank you for applying.", "Hello {{ user.first_name | title }}!", "Your appointment is on {date} at {time}.", "Kind regards,\n[Sender Name]", "Welcome to ${site_name}, please confirm ${email}.", "Order #{{order_number}} was placed.", "The meeting with <%= client %> moved to Friday.", "Ship to: %%ADDRESS%%", "Contact @@EMAIL@@ for help.",
    "The winner is [WINNER NAME].", "Your code is %(code)s.", "Hola [Nombre], gracias por tu compra.", "Sehr geehrter Herr [Nachname],", "Chère [Prénom], merci.", "Copyright {year} {company_name}", "<Your Company> is proud to announce.", "[TBD: speaker list]", "[placeholder for the chart]", "Insert text here", "Lorem ipsum dolor sit amet",
    "Sed ut labore et dolore magna aliqua. Ut enim ad minim veniam.", "Sample text sample text sample text", "Coming soon!", "This page is under construction.", "null null null null", "NaN NaN NaN", "asdf asdf asdf asdf", "Este es un texto de ejemplo.", "Testo segnaposto.", "Hier entsteht eine neue Internetpräsenz.",
    "503 Service Temporarily Unavailable", "403 Forbidden nginx/1.18.0", "Error 404 (Not Found)!!1", "HTTP 500", "Service Unavailable", "Gateway Timeout", "Request Entity Too Large", "Connection refused", "Connection timed out", "The server returned an invalid response.", "Too many redirects", "This page isn’t working", "This account has been suspended.",
    "We couldn’t find the page you were looking for.", "The file you are looking for has been removed.", "Sorry, this content is not available in your region.", "You don’t have permission to access this resource.", "Your session timed out. Please log in again.", "Der Server ist vorübergehend nicht erreichbar.", "Die angeforderte Seite existiert nicht.", "Zugriff auf diese Seite nicht erlaubt.",
    "Erreur 404 : page introuvable", "Accès refusé", "Le serveur ne répond pas.", "Error 404: página no encontrada", "Acceso denegado", "Accesso negato", "Erro 500", "Acesso negado", "Toegang geweigerd", "Warning: Undefined variable $x in /home/site/page.php on line 12", "TypeError: Cannot read properties of undefined (reading 'map')", "SQLSTATE[HY000] [2002] Connection refused",
    "Exception in thread \"main\" java.lang.OutOfMemoryError", "Segmentation fault (core dumped)", "You need to enable JavaScript to run this app.", "This website uses JavaScript. Turn it on in your settings.", "Bitte aktivieren Sie Cookies in Ihrem Browser.", "Activez les cookies pour continuer.", "Abilita JavaScript per visualizzare questo sito.", "Schakel JavaScript in om deze pagina te bekijken.", "Ative o JavaScript para continuar.",
    "Your browser does not support the video tag.", "This site requires a browser with cookies enabled.", "Are you a robot? Please confirm that you are human.", "We have detected unusual traffic from your network.", "Please wait while we verify your browser.", "Access denied. Your IP address has been blocked.", "Click here if you are not redirected automatically.",
]
HELD_CLEAN = [
    "The waiter could not find the file of reservations.", "Her request was turned down twice by the board.", "The old mill was found empty in 1903.", "He asked whether the door was locked.", "Visitors are not permitted to touch the exhibits.", "The library is closed on Mondays and public holidays.", "We lost the connection in Munich and took the next train.", "The document was found in an attic in Ghent.",
    "No page of the diary survives.", "The address was delivered by the mayor.", "The host was busy in the kitchen.", "The captain refused to leave the ship.", "The service was terminated in 1962 for lack of passengers.", "Their account of the battle differs.", "The network of canals was extended in 1820.", "An unexpected frost killed the vines.",
    "JavaScript was created in ten days in 1995.", "Most browsers support cookies.", "The developer explained why scripts slow a page down.", "A 404 error page can be funny, the designer argued.", "Servers return a 503 status when they are overloaded.", "nginx was written by a Russian engineer.", "The word null comes from Latin.", "Lorem ipsum has been the printers' filler text since the 1960s.",
    "In LaTeX, \\textbf{word} prints bold text.", "The citation [Smith 2004] is wrong.", "See [1] and [2] for proofs.", "[Music playing] [Door closes]", "[MR. SMITH] I object.", "The interval (0, 1) and the set {0, 1} differ.", "Let {a_n} be a sequence of reals.", "If x < y and y > z, stop.", "The tags <div> and <span> have no meaning.", "In a shell, ${HOME} expands to your home directory.",
    "Write `%s` where the text should go.", "Mustache templates mark fields as {{name}}.", "A placeholder such as [NAME] is filled in by the mail program.", "def f(x):\n    return {\"a\": x}\n", "The acronym [UNESCO] appears twice.", "Profit rose by 10%Q1 was weak.", "Contact: john_doe__smith", "He scored 100%.", "@@ is the merge marker in a diff.", "Mein Browser ist alt, aber er läuft.",
    "Die Sitzung wurde um zehn Uhr geschlossen.", "Der Zugang zum Park wurde ihm verweigert.", "La page est arrachée.", "Le service est compris dans le prix.", "El servidor público pidió perdón.", "La puerta está cerrada.", "Il servizio era ottimo.", "He went on and on and on.", "Ha ha ha ha, she laughed.", "The bells went ding dong ding dong.", "Buffalo buffalo buffalo.",
    "My colleague was blocked from entering the chamber.", "She has moved to Vienna and no longer writes.", "They enabled the alarm and left.", "To enable the poor to read, he founded a school.", "The new law requires drivers to carry a permit.", "Please turn off the lights.", "Please log the hours you worked.", "You must be registered to vote.", "Loading the cargo took all night.", "This is the sample the doctor took.",
    "The dummy sat in the shop window.", "The text goes on for ten pages.", "More details follow in chapter two.", "To be continued.", "Your request has been noted, said the clerk.", "Error is human.", "Fatal accidents fell by a third.", "The exception proves the rule.", "Warning: contains nuts.", "Notice of the meeting was given on line and in print.", "Access is by the south gate.",
]
