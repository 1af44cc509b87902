#: The folder whose tables the registered queries are checked on.
CHECKED = "/root/testdata/sf0.01"
