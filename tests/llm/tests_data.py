import os

DATA = "/root/testdata/sf0.001"


def views(con):
    for t in os.listdir(DATA):
        con.execute(f"create view {t.split('.')[0]} as select * from '{DATA}/{t}'")
