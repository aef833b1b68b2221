"""Labelled residue exemplars. Fixed values, one list for each kind."""

from __future__ import annotations

#: Demands to switch scripts on and checks of the browser.
SCRIPTS = [
    "You need to allow JavaScript to run this app.",
    "Your browser has scripting switched off, so nothing can be shown here.",
    "This site requires scripts. Turn them on and reload.",
    "Please enable JavaScript in your browser to view this page.",
    "JavaScript is disabled. Enable JavaScript to continue.",
    "This page works only with JavaScript enabled.",
    "We are checking your connection before you can go on. This takes a few seconds.",
    "Checking your browser before you continue.",
    "Are you a robot?",
    "Just a moment…",
    "Loading…",
    "Verify that you are human.",
    "В вашем браузере отключены сценарии.",
    "Сайт не работает без скриптов. Разрешите их и обновите страницу.",
    "Для просмотра страницы включите JavaScript в браузере.",
    "Мы проверяем ваше соединение, это займёт несколько секунд.",
    "Проверка браузера",
    "Подтвердите, что вы не робот.",
    "Bu sayfayı görmek için JavaScript özelliğini açın.",
    "Site betikler olmadan çalışmaz. Lütfen izin verip yenileyin.",
    "Tarayıcınızda betikler kapalı.",
    "Bağlantınız denetleniyor, birkaç saniye sürer.",
    "Tarayıcı denetleniyor",
    "Robot olmadığınızı doğrulayın.",
    "Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.",
    "Diese Seite braucht Skripte. Bitte einschalten und neu laden.",
    "In Ihrem Browser sind Skripte abgeschaltet.",
    "Wir prüfen Ihre Verbindung. Das dauert einige Sekunden.",
    "Einen Augenblick bitte",
    "Browser wird geprüft",
    "Ce site a besoin des scripts pour fonctionner.",
    "Veuillez activer JavaScript pour afficher cette page.",
    "Votre navigateur bloque les scripts ; rechargez la page après les avoir autorisés.",
    "Nous vérifions votre connexion, merci de patienter quelques secondes.",
    "Vérification en cours",
    "Este sitio necesita scripts; habilítelos y vuelva a cargar.",
    "Active JavaScript en su navegador para ver esta página.",
    "Su navegador tiene los scripts desactivados.",
    "Estamos comprobando su conexión; tardará unos segundos.",
    "Comprobando el navegador",
    "Please turn on JavaScript to use this site.",
    "JavaScript is required to view this page.",
    "It looks like JavaScript is turned off in your browser.",
    "Your browser does not support JavaScript.",
    "Enable JavaScript and cookies to continue.",
    "Complete the security check to continue.",
    "Please verify you are a human.",
    "Для работы сайта требуется JavaScript.",
    "JavaScript отключён в вашем браузере.",
    "Пройдите проверку безопасности, чтобы продолжить.",
    "Bu site JavaScript gerektirir.",
    "Tarayıcınızda JavaScript kapalı.",
    "Devam etmek için JavaScript’i etkinleştirin.",
    "Bitte schalten Sie JavaScript ein.",
    "Diese Seite benötigt JavaScript.",
    "JavaScript ist in Ihrem Browser deaktiviert.",
    "Ce site nécessite JavaScript.",
    "JavaScript est désactivé dans votre navigateur.",
    "Este sitio requiere JavaScript.",
    "JavaScript está desactivado en su navegador.",
    "Habilite JavaScript para continuar.",
]

#: Pages of servers that failed, and lines that programs left in a page.
ERRORS = [
    "404 Not Found",
    "403 Forbidden",
    "Error 502: bad gateway",
    "Error 500",
    "Error 500: internal server error",
    "Error 503: service unavailable",
    "Page unavailable",
    "Page not found",
    "Access denied",
    "Service temporarily unavailable",
    "The page you asked for has been moved or no longer exists.",
    "Could not connect to the database.",
    "Contact the administrator of the site.",
    "You do not have permission to open /page.",
    "Reference number: 5",
    "You don't have permission to open /page on this server.",
    "Too many requests from your address.",
    "The upstream server did not answer in time.",
    "Try again in 5 minutes.",
    "Warning: undefined variable $lead in /srv/site/view.php on line 12",
    "Fatal error: allowed memory of 128 MB exhausted",
    "Traceback: template error in block “teaser”",
    "Uncaught exception in template renderer",
    "Error rendering component StoryBody: 4k2x",
    "Ошибка 503",
    "Страница не найдена",
    "Страница недоступна",
    "Доступ запрещён",
    "Сервис временно недоступен",
    "Запрошенная страница удалена или перемещена.",
    "Нет соединения с базой данных.",
    "Обратитесь к администратору сайта.",
    "У вас нет прав на просмотр /page.",
    "Номер обращения: 5",
    "Код обращения: 5",
    "Сервер не ответил вовремя. Повторите через 5 минут.",
    "Слишком много запросов с вашего адреса.",
    "Hata 500",
    "Sayfa bulunamadı",
    "Erişim engellendi",
    "Hizmet geçici olarak kullanılamıyor",
    "Aradığınız sayfa taşınmış ya da silinmiş.",
    "Sunucu yanıt vermedi. 5 dakika sonra yeniden deneyin.",
    "Veritabanına bağlanılamadı.",
    "Bu sayfayı açma yetkiniz yok: /page",
    "Başvuru numarası: 5",
    "Başvuru no: 5",
    "Adresinizden çok fazla istek geldi.",
    "Fehler 500",
    "Seite nicht gefunden",
    "Zugriff verweigert",
    "Dienst vorübergehend nicht verfügbar",
    "Die gewünschte Seite wurde verschoben oder gelöscht.",
    "Der Server antwortet nicht. Versuchen Sie es in 5 Minuten erneut.",
    "Keine Verbindung zur Datenbank.",
    "Sie haben keine Berechtigung für /page.",
    "Referenznummer: 5",
    "Vorgangsnummer: 5",
    "Zu viele Anfragen von Ihrer Adresse.",
    "Erreur 500",
    "Page introuvable",
    "Accès refusé",
    "Service momentanément indisponible",
    "La page demandée a été déplacée ou supprimée.",
    "Le serveur n’a pas répondu. Réessayez dans 5 minutes.",
    "Connexion à la base de données impossible.",
    "Vous n’avez pas le droit d’ouvrir /page.",
    "Référence : 5",
    "Trop de requêtes depuis votre adresse.",
    "Página no encontrada",
    "Acceso denegado",
    "Servicio no disponible por el momento",
    "La página solicitada se ha movido o ya no existe.",
    "El servidor no respondió. Inténtelo de nuevo en 5 minutos.",
    "No se pudo conectar con la base de datos.",
    "No tiene permiso para ver /page.",
    "No tiene permiso para abrir /page.",
    "Número de referencia: 5",
    "Referencia: 5",
    "Demasiadas solicitudes desde su dirección.",
    "500 Internal Server Error",
    "502 Bad Gateway",
    "503 Service Unavailable",
    "504 Gateway Timeout",
    "The requested URL was not found on this server.",
    "Sorry, the page you are looking for could not be found.",
    "The server encountered an internal error and was unable to complete your request.",
    "An error occurred while processing your request.",
    "Oops! Something went wrong.",
    "This page is not available.",
    "Ошибка 404: страница не найдена",
    "Внутренняя ошибка сервера",
    "Произошла ошибка при обработке запроса.",
    "Извините, запрашиваемая страница не найдена.",
    "Hata 404: sayfa bulunamadı",
    "İsteğiniz işlenirken bir hata oluştu.",
    "Sunucu hatası",
    "Fehler 404: Seite nicht gefunden",
    "Die angeforderte Seite wurde nicht gefunden.",
    "Bei der Verarbeitung ist ein Fehler aufgetreten.",
    "Interner Serverfehler",
    "Erreur 404 : page non trouvée",
    "Désolé, la page que vous cherchez n’existe pas.",
    "Une erreur est survenue lors du traitement de votre demande.",
    "Erreur interne du serveur",
    "Error 404: página no encontrada",
    "Lo sentimos, la página que busca no existe.",
    "Se ha producido un error al procesar su solicitud.",
    "Error interno del servidor",
]

#: Text that stands in for a story which nobody has written.
FILLER = [
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. "
    "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. "
    "Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. "
    "Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.",
    "This is dummy content; the editor will supply the story later.",
    "Your text goes here. Replace this paragraph with your own copy.",
    "Type your article here…",
    "Sample text sample text sample text sample text.",
    "Образец текста образец текста образец текста.",
    "Здесь будет текст статьи. Замените этот абзац своим.",
    "Рыбный текст для проверки вёрстки, он ничего не значит.",
    "Sayfa düzeni için deneme metni, anlamı yoktur.",
    "Metniniz buraya gelecek. Bu paragrafı değiştirin.",
    "Blindtext zur Ansicht des Layouts, ohne Inhalt.",
    "Hier steht Ihr Text. Bitte diesen Absatz ersetzen.",
    "Votre texte ici. Remplacez ce paragraphe.",
    "Faux texte pour la maquette, sans contenu.",
    "Texte de remplissage, à supprimer avant publication.",
    "Texto de relleno para la maqueta, sin contenido.",
    "Escriba aquí su texto. Sustituya este párrafo.",
    "Untitled document",
    "Placeholder text, to be replaced before publication.",
    "Insert your text here.",
    "Документ без названия",
    "Вставьте сюда свой текст.",
    "Adsız belge",
    "Unbenanntes Dokument",
    "Platzhaltertext, bitte vor der Veröffentlichung ersetzen.",
    "Document sans titre",
    "Insérez votre texte ici.",
    "Documento sin título",
    "Inserte su texto aquí.",
]

#: Holes that a template engine or a sub-editor should have filled.
HOLES = [
    "{{ article.lead }}", "{{author_name}}", "{% block story %}", "{0}", "{$teaser}", "${headline}", "%%BYLINE%%",
    "[[lead]]", "[[%story.intro]]", "<%= story.summary %>", "<<caption>>", "#CITY_NAME#", "@@deck@@",
    "__BODY_TEXT__", "%(place)s", "[INSERT QUOTE HERE]", "<INSERT NAME>", "&lt;INSERT NAME&gt;",
    "[object Object]", "undefined", "TKTK", "[FIRST NAME]",
]

#: Labelled as no residue: words about such things.
MENTIONS = [
    "explains what a tag such as {{ name }} does in a mail template",
    "зачем сайту JavaScript и что значит тег {{ name }}",
    "erklärt, was ein Platzhalter wie {{ name }} in einer Vorlage bewirkt",
    "explique ce que fait une balise comme {{ name }} dans un modèle",
    "explica qué hace una etiqueta como {{ name }} en una plantilla",
    "bir şablonda {{ name }} gibi bir etiketin ne yaptığını anlatıyor",
    "still asked readers to enable JavaScript",
    "traced the “404 not found” page to a typo",
    "joked that the “lorem ipsum” text read better",
]
