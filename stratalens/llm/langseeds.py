"""A few plain sentences in each language, to start training from.

They only decide which labelled rows of the corpus are trusted; the models are
trained on those rows together with these sentences.
"""

SEEDS: dict[str, str] = {
    "ru": """Если пользователь открывает документ, программа проверяет права и показывает последние изменения. Этот отчёт можно
        настроить так, чтобы он выводил только те строки, которые были изменены сегодня. После этого нужно закрыть окно и подождать,
        пока завершится обработка. Мы не рекомендуем удалять эти записи, потому что они ещё используются в других местах. Как правило,
        ошибка появляется из-за того, что не заполнено обязательное поле. Напоминаем, что склад и организация должны быть указаны до
        проведения. Что делать, если сумма не сходится? Сначала посмотрите, какие движения были сделаны за месяц. Здравствуйте, подскажите,
        пожалуйста, почему у меня пропадает список товаров, когда я нажимаю кнопку. Теперь всё работает быстрее, чем раньше, и это видно
        даже на больших базах. Чтобы исправить это, перейдите в карточку и запишите её заново. Он был создан вчера, но его никто не видел.""",
    "uk": """Якщо користувач відкриває документ, програма перевіряє права та показує останні зміни. Цей звіт можна налаштувати так, щоб
        він виводив лише ті рядки, які були змінені сьогодні. Після цього потрібно закрити вікно і зачекати, поки завершиться обробка.
        Ми не радимо видаляти ці записи, бо вони ще використовуються в інших місцях. Зазвичай помилка з'являється через те, що не заповнено
        обов'язкове поле. Нагадуємо, що склад і організація мають бути вказані до проведення. Що робити, якщо сума не збігається? Спочатку
        подивіться, які рухи було зроблено за місяць. Добрий день, підкажіть, будь ласка, чому в мене зникає список товарів, коли я натискаю
        кнопку. Тепер усе працює швидше, ніж раніше, і це видно навіть на великих базах. Щоб виправити це, перейдіть до картки та запишіть
        її знову. Його було створено вчора, але його ніхто не бачив.""",
    "bg": """Ако потребителят отвори документа, програмата проверява правата и показва последните промени. Тази справка може да се настрои
        така, че да извежда само онези редове, които са променени днес. След това трябва да затворите прозореца и да изчакате, докато
        обработката приключи. Не препоръчваме да изтривате тези записи, защото те все още се използват на други места. Обикновено грешката
        се появява, когато не е попълнено задължително поле. Напомняме, че складът и фирмата трябва да бъдат посочени преди осчетоводяването.
        Какво да направите, ако сумата не съвпада? Първо вижте кои движения са били направени през месеца. Здравейте, кажете ми, моля, защо
        списъкът със стоките изчезва, когато натисна бутона. Сега всичко работи по-бързо от преди и това се вижда дори при големи бази.
        За да поправите това, отидете в картата и я запишете отново. Той беше създаден вчера, но никой не го е видял.""",
    "en": """If the user opens the document, the program checks the rights and shows the latest changes. This report can be set up so that
        it prints only the lines which were changed today. After that you have to close the window and wait until the processing has ended.
        We do not recommend deleting these records because they are still used in other places. As a rule the error appears when a required
        field is not filled in. Remember that the warehouse and the company must be given before posting. What should be done when the sum
        does not match? First look at which movements were made during the month. Hello, please tell me why the list of goods is lost when I
        press the button. Now everything works faster than before, and this can be seen even with large databases. To fix it, go to the card
        and save it again. It was created yesterday, but nobody has seen it.""",
    "de": """Wenn der Benutzer den Beleg öffnet, prüft das Programm die Rechte und zeigt die letzten Änderungen. Dieser Bericht kann so
        eingestellt werden, dass er nur die Zeilen ausgibt, die heute geändert wurden. Danach muss man das Fenster schließen und warten, bis
        die Verarbeitung beendet ist. Wir empfehlen nicht, diese Einträge zu löschen, weil sie noch an anderen Stellen verwendet werden. In
        der Regel erscheint der Fehler, weil ein Pflichtfeld nicht gefüllt ist. Bitte beachten Sie, dass Lager und Firma vor der Buchung
        angegeben sein müssen. Was ist zu tun, wenn die Summe nicht stimmt? Sehen Sie zuerst nach, welche Bewegungen im Monat gemacht wurden.
        Guten Tag, können Sie mir bitte sagen, warum die Liste der Waren verschwindet, wenn ich auf die Schaltfläche drücke. Jetzt läuft alles
        schneller als früher, und das merkt man auch bei großen Datenbanken. Er wurde gestern angelegt, aber niemand hat ihn gesehen.""",
    "fr": """Si l'utilisateur ouvre le document, le programme vérifie les droits et affiche les dernières modifications. Ce rapport peut être
        réglé pour n'afficher que les lignes qui ont été modifiées aujourd'hui. Ensuite il faut fermer la fenêtre et attendre que le traitement
        soit terminé. Nous ne conseillons pas de supprimer ces enregistrements parce qu'ils sont encore utilisés ailleurs. En général l'erreur
        apparaît quand un champ obligatoire n'est pas rempli. Nous rappelons que l'entrepôt et la société doivent être indiqués avant la
        validation. Que faire si la somme ne correspond pas ? Regardez d'abord quels mouvements ont été faits pendant le mois. Bonjour, pouvez-vous
        me dire pourquoi la liste des articles est perdue quand j'appuie sur le bouton. Maintenant tout fonctionne plus vite qu'avant, et cela se
        voit même avec de grandes bases. Il a été créé hier, mais personne ne l'a vu.""",
    "es": """Si el usuario abre el documento, el programa comprueba los permisos y muestra los últimos cambios. Este informe se puede ajustar
        para que muestre solo las líneas que se modificaron hoy. Después hay que cerrar la ventana y esperar a que termine el proceso. No
        recomendamos eliminar estos registros porque todavía se usan en otros lugares. Por lo general el error aparece cuando no se ha rellenado
        un campo obligatorio. Recordamos que el almacén y la empresa deben indicarse antes de contabilizar. ¿Qué hacer si la suma no coincide?
        Primero mire qué movimientos se hicieron durante el mes. Hola, por favor, dígame por qué desaparece la lista de artículos cuando pulso el
        botón. Ahora todo funciona más rápido que antes y eso se nota incluso con bases grandes. Fue creado ayer, pero nadie lo ha visto.""",
    "pl": """Jeśli użytkownik otwiera dokument, program sprawdza uprawnienia i pokazuje ostatnie zmiany. Ten raport można ustawić tak, aby
        wyświetlał tylko te wiersze, które zostały dzisiaj zmienione. Potem trzeba zamknąć okno i poczekać, aż przetwarzanie się zakończy. Nie
        zalecamy usuwania tych wpisów, ponieważ są one nadal używane w innych miejscach. Zazwyczaj błąd pojawia się, gdy nie wypełniono
        wymaganego pola. Przypominamy, że magazyn i firma muszą być wskazane przed zaksięgowaniem. Co zrobić, jeśli suma się nie zgadza? Najpierw
        sprawdź, jakie ruchy zostały wykonane w ciągu miesiąca. Dzień dobry, proszę powiedzieć, dlaczego lista towarów znika, kiedy naciskam
        przycisk. Teraz wszystko działa szybciej niż wcześniej i widać to nawet przy dużych bazach. Utworzono go wczoraj, ale nikt go nie widział.""",
}

#: Ways in which a label names one of the languages.
NAMES: dict[str, str] = {
    "ru": "ru rus russian русский русск russisch russe ruso rosyjski",
    "uk": "uk ukr ukrainian українська украинский ua ukrainisch",
    "bg": "bg bul bulgarian български болгарский bulgarisch",
    "en": "en eng english английский englisch anglais inglés angielski",
    "de": "de deu ger german deutsch немецкий allemand",
    "fr": "fr fra fre french français francais französisch французский",
    "es": "es spa spanish español espanol castellano spanisch испанский",
    "pl": "pl pol polish polski польский polnisch",
}
