"""Labelled lines of the page around an article. Fixed values, one list for each kind.

"#" stands for digits and "@" for a name of any length. The lists are the training labels of the
block labeller and tell prose from page text where whole paragraphs are asked for.
"""

from __future__ import annotations

import re

#: Words of menus and buttons that make up a whole line or its parts.
MENU = """
archive|technology|video|contact|subscribe|weather|home|menu|search|world|science|jobs|opinion|sign in|log in|accept all|reject all|cookie settings|privacy notice
back to top|copy link|related stories|most read|advertise|careers|terms of use|share|print|comments|about us
архив|технологии|видео|контакты|подписка|погода|главная|меню|поиск|мир|наука|вакансии|мнения|мнение|войти|принять все|отклонить|отклонить все|настройки cookie
политика конфиденциальности|наверх|скопировать ссылку|материалы по теме|самое читаемое|реклама|условия
archives|technologie|technologies|vidéo|vidéos|s’abonner|abonnement|abonnements|météo|accueil|emploi|recherche|rechercher|monde|sciences|emplois|avis|opinions|connexion|se connecter|tout accepter|tout refuser|gérer les cookies
confidentialité|haut de page|copier le lien|sur le même sujet|les plus lus|publicité|conditions
archiv|technik|kontakt|video|videos|abo|wetter|startseite|menü|suche|welt|wissen|stellen|meinung|anmelden|alle annehmen|alle ablehnen|cookie-einstellungen
datenschutz|nach oben|link kopieren|zum selben thema|meistgelesen|werbung|karriere|nutzungsbedingungen
archivo|hemeroteca|tecnología|vídeo|vídeos|contacto|suscripción|suscribirse|el tiempo|tiempo|portada|inicio|menú|buscar|mundo|ciencia|empleo|opinión|entrar|iniciar sesión|aceptar todo|rechazar todo|configurar cookies
privacidad|volver arriba|copiar enlace|sobre el mismo tema|lo más leído|publicidad|condiciones
arşiv|teknoloji|video|iletişim|abone ol|hava durumu|ana sayfa|menü|ara|dünya|bilim|iş ilanları|görüş|giriş|giriş yap|tümünü kabul et|reddet|tümünü reddet|çerez ayarları
skip to main content|related articles|read more|load more|next article|previous article|print this page|sign up|my account|latest news|follow us|download app|editors’ picks|in pictures|live|quiz
перейти к содержанию|похожие статьи|читать дальше|показать ещё|следующая статья|распечатать|регистрация|личный кабинет|последние новости|мы в соцсетях|выбор редакции
aller au contenu|articles liés|lire la suite|voir plus|article suivant|imprimer|s’inscrire|mon compte|dernières nouvelles|suivez-nous|choix de la rédaction
zum inhalt springen|ähnliche artikel|weiterlesen|mehr laden|nächster artikel|drucken|registrieren|mein konto|neueste nachrichten|folgen sie uns|auswahl der redaktion
saltar al contenido|artículos relacionados|leer más|cargar más|siguiente artículo|imprimir|registrarse|mi cuenta|últimas noticias|síganos|selección del editor
içeriğe geç|ilgili yazılar|devamını oku|daha fazla göster|sonraki yazı|yazdır|kaydol|hesabım|son haberler|bizi takip edin|editörün seçtikleri
gizlilik|gizlilik bildirimi|yukarı çık|bağlantıyı kopyala|ilgili haberler|en çok okunanlar|reklam|kariyer|koşullar
"""

#: Lines with open places.
LINES = """
@ uses cookies. By continuing to browse you accept our use of them.
We and our # partners use cookies to personalise content and measure traffic. Manage your choices at any time.
Updated #:#
Published #-#-# #:# | # min read
Comments (#)
# shares
Share this article with your friends
Like us, tell a colleague, print this page
Follow @ for the latest updates
More from @
Newsletter: one mail every morning, # readers already signed up
All content on @ is protected; reproduction without written consent is prohibited.
The views expressed here do not represent those of @.
@ is not responsible for the content of external pages.
© # @. All rights reserved.
@, registered office in @
About @ | Advertise | Careers | Terms of use
@ | @ science desk
@, staff writer
By @
Recommended: @
Trending now: @
Read also: @
Tags: @
@ использует файлы cookie. Оставаясь на сайте, вы соглашаетесь с этим.
Мы и # наших партнёров используем файлы cookie, чтобы настраивать материалы и считать посещения.
Обновлено #:#
Опубликовано #-#-# #:# | # мин чтения
Комментарии (#)
Поделились: #
Поделитесь этой статьёй с друзьями
Нравится материал? Расскажите коллегам
Подписывайтесь на @ и следите за обновлениями
Ещё на @
Рассылка: одно письмо каждое утро, уже # читателей
Все материалы @ защищены; перепечатка без письменного согласия запрещена.
Мнение автора может не совпадать с мнением редакции @.
@ не отвечает за содержание внешних страниц.
© # @. Все права защищены.
@, редакция в @
О проекте @ | Реклама | Вакансии | Условия
@ | отдел науки @
@, корреспондент
Автор: @
Рекомендуем: @
Сейчас обсуждают: @
Читайте также: @
Метки: @
Теги: @
@ utilise des cookies. En poursuivant, vous acceptez leur usage.
Nous et nos # partenaires utilisons des cookies pour personnaliser les contenus et mesurer l’audience.
Mis à jour à #:#
Publié le #/#/# à #:# | # min de lecture
Commentaires (#)
# partages
Partagez cet article avec vos proches
Cet article vous a plu ? Faites-le savoir
Suivez @ pour ne rien manquer
Plus sur @
Lettre du matin : déjà # lecteurs inscrits
Tous les contenus de @ sont protégés ; reproduction interdite sans accord écrit.
Les propos tenus n’engagent pas @.
@ n’est pas responsable des pages externes.
© # @. Tous droits réservés.
@, siège à @
À propos de @ | Publicité | Emplois | Conditions
@ | rédaction sciences de @
@, journaliste
Par @
Recommandé : @
En ce moment : @
À lire aussi : @
Lire aussi : @
À ne pas manquer : @
Mots-clés : @
@ verwendet Cookies. Mit der weiteren Nutzung stimmen Sie dem zu.
Wir und unsere # Partner verwenden Cookies, um Inhalte anzupassen und Zugriffe zu messen.
Aktualisiert um #:# Uhr
Aktualisiert #:#
Veröffentlicht am #.#.#, #:# Uhr | # Min. Lesezeit
Kommentare (#)
# Mal geteilt
Teilen Sie diesen Artikel mit Freunden
Hat Ihnen der Beitrag gefallen? Sagen Sie es weiter
Folgen Sie @ und bleiben Sie auf dem Laufenden
Mehr von @
Morgenbrief: schon # Leserinnen und Leser
Alle Inhalte von @ sind geschützt; Nachdruck nur mit schriftlicher Zustimmung.
Die Meinung der Autoren muss nicht jener von @ entsprechen.
@ haftet nicht für fremde Seiten.
© # @. Alle Rechte vorbehalten.
@, Sitz in @
Über @ | Werbung | Karriere | Nutzungsbedingungen
@ | Wissenschaftsressort @
@, Redaktion
Von @
Empfohlen: @
Gerade im Gespräch: @
Lesen Sie auch: @
Schlagwörter: @
@ utiliza cookies. Si continúa navegando, acepta su uso.
Nosotros y nuestros # socios usamos cookies para personalizar contenidos y medir visitas.
Actualizado a las #:#
Publicado el #/#/# a las #:# | # min de lectura
Comentarios (#)
# veces compartido
Comparte este artículo con tus amigos
¿Te ha gustado? Cuéntaselo a alguien
Sigue a @ para no perderte nada
Más en @
Boletín de la mañana: ya son # lectores
Todos los contenidos de @ están protegidos; prohibida su reproducción sin permiso escrito.
Las opiniones expresadas no representan a @.
@ no responde de las páginas externas.
© # @. Todos los derechos reservados.
@, sede en @
Quiénes somos en @ | Publicidad | Empleo | Condiciones
@ | sección de ciencia de @
@, redacción
Por @
Recomendado: @
Ahora se habla de: @
Lea también: @
Etiquetas: @
# min read
Reading time: # minutes
Last updated: @
Photo: @
Image: @
Source: @
Filed under: @
Topics: @
This website uses cookies to improve your experience.
By using this site you agree to our privacy policy.
Sign up to our newsletter
Subscribe to read the full article
Copyright # @
# comments
Время чтения: # мин
Фото: @
Источник: @
Темы: @
Этот сайт использует cookie.
Подпишитесь на нашу рассылку
Temps de lecture : # min
Photo : @
Source : @
Thèmes : @
Ce site utilise des cookies.
Abonnez-vous à notre lettre d’information
Lesezeit: # Minuten
Foto: @
Bild: @
Quelle: @
Themen: @
Diese Website verwendet Cookies.
Abonnieren Sie unseren Newsletter
Tiempo de lectura: # min
Foto: @
Fuente: @
Temas: @
Este sitio utiliza cookies.
Suscríbase a nuestro boletín
Okuma süresi: # dakika
Fotoğraf: @
Kaynak: @
Konular: @
Bu site çerez kullanmaktadır.
Bültenimize abone olun
@ çerez kullanır. Devam ederek bunu kabul edersiniz.
Biz ve # ortağımız içeriği kişiselleştirmek ve ziyaretleri ölçmek için çerez kullanıyoruz.
Güncelleme #:#
Yayın: #.#.# #:# | # dk okuma
Yorumlar (#)
# paylaşım
Bu yazıyı arkadaşlarınızla paylaşın
Yazıyı beğendiniz mi? Başkalarına da anlatın
@ hesabını takip edin
@ içinde daha fazlası
Sabah bülteni: şimdiden # okur
Tüm @ içeriği korunmaktadır; yazılı izin olmadan çoğaltılamaz.
@ içeriğinin tamamı korunmaktadır; yazılı izin olmadan çoğaltılamaz.
Yazarların görüşleri @ görüşünü yansıtmayabilir.
@ dış sayfalardan sorumlu değildir.
© # @. Tüm hakları saklıdır.
@, merkez @
@ hakkında | Reklam | Kariyer | Koşullar
@ | @ bilim servisi
@, muhabir
Haber: @
Önerilen: @
Şu an konuşulan: @
Bunu da okuyun: @
Etiketler: @
"""


def squeezed(line: str) -> str:
    """Lower case, single spaces, runs of digits as one digit."""
    return re.sub(r"\d+", "0", " ".join(line.split())).lower().replace("i̇", "i")


WORDS = frozenset(w for row in MENU.strip().split("\n") for w in map(squeezed, row.split("|")))
_OPEN = [squeezed(x) for x in LINES.strip().split("\n")]


def _pattern(line: str) -> str:
    # a title may follow a colon, else an open place is a name
    return re.escape(line).replace("\\#", "0").replace("@", ".{1,160}" if line.endswith((": @", " : @")) else "[^.!?0:]{1,60}?")


PATTERN = re.compile("(?:" + "|".join(map(_pattern, dict.fromkeys(_OPEN))) + ")$")
SEPARATOR = re.compile(r"\s*[|/·•>»]\s*|\s{2,}")
RANKED = re.compile(r"0\. \S")
SENTENCE_END = re.compile(r"[.!?…](?=[”»\"“’)]*(?:\s|$))")
LIST_ITEM = re.compile(r"\s*(?:[*•–-]|\d+\))\s+\S")


def is_furniture(line: str) -> bool:
    """Does the line repeat a labelled one?"""
    s = squeezed(line)
    if s in WORDS or PATTERN.match(s) or RANKED.match(s):
        return True
    parts = [squeezed(p) for p in SEPARATOR.split(line.strip()) if p.strip()]
    return len(parts) > 1 and (sum(p in WORDS for p in parts) * 2 >= len(parts) or parts[0] in WORDS) or _all_menu(s)


def _all_menu(s: str) -> bool:
    """Menu words side by side without a separator."""
    words = s.split()
    i = 0
    while i < len(words):
        for n in (3, 2, 1):
            if " ".join(words[i : i + n]) in WORDS and len(words[i : i + n]) == n:
                i += n
                break
        else:
            return False
    return bool(words)


def is_prose(line: str) -> bool:
    """A whole paragraph: two sentences or more, not of the page around."""
    return len(line) >= 60 and len(SENTENCE_END.findall(line.strip())) >= 2 and not is_furniture(line)
