"""A small FTP server for tests: files in memory, transfers over passive connections, restarts at offsets."""

import socket
import socketserver
import threading


class _Session(socketserver.StreamRequestHandler):
    def say(self, text):
        self.wfile.write((text + "\r\n").encode())

    def handle(self):
        files, self.offset, self.data, renamed, known = self.server.files, 0, None, None, False
        self.server.sessions += 1
        self.say("220 ready")
        for line in self.rfile:
            command, _, value = line.decode().strip().partition(" ")
            command = command.upper()
            if command == "PASS":
                known = value == "right"
                self.say("230 in" if known else "530 no")
            elif command == "USER":
                self.say("331 password")
            elif command == "QUIT":
                self.say("221 bye")
                return
            elif not known:
                self.say("530 no")
            elif command == "TYPE":
                self.say("200 ok")
            elif command == "SIZE":
                self.say(f"213 {len(files[value])}" if value in files else "550 none")
            elif command in ("PASV", "EPSV"):
                self.data = socket.create_server(("127.0.0.1", 0))
                port = self.data.getsockname()[1]
                self.say(f"227 (127,0,0,1,{port // 256},{port % 256})" if command == "PASV" else f"229 (|||{port}|)")
            elif command == "REST":
                self.offset = int(value)
                self.say("350 ok")
            elif command == "RETR" and value not in files:
                self.say("550 none")
            elif command in ("RETR", "STOR", "APPE"):
                self.say("150 go")
                link, _ = self.data.accept()
                if command == "RETR":
                    self.server.reads.append((value, self.offset))
                    try:
                        link.sendall(files[value][self.offset :])
                        answer = "226 done"
                    except OSError:
                        answer = "426 cut short"
                else:
                    got = b""
                    while block := link.recv(1 << 16):
                        got += block
                    files[value] = (files.get(value, b"") if command == "APPE" else b"") + got
                    answer = "226 done"
                link.close()
                self.data.close()
                self.offset = 0
                self.say(answer)
            elif command == "RNFR":
                renamed = value
                self.say("350 ok" if value in files else "550 none")
            elif command == "RNTO":
                files[value] = files.pop(renamed)
                self.say("250 ok")
            elif command == "DELE":
                self.say("250 ok" if files.pop(value, None) is not None else "550 none")
            else:
                self.say("502 unknown")


class FtpServer(socketserver.ThreadingTCPServer):
    daemon_threads = True
    allow_reuse_address = True

    def __init__(self):
        super().__init__(("127.0.0.1", 0), _Session)
        self.files, self.reads, self.sessions = {}, [], 0

    def __enter__(self):
        threading.Thread(target=self.serve_forever, daemon=True).start()
        return self

    def __exit__(self, *_):
        self.shutdown()
        self.server_close()

    @property
    def login(self):
        return {"type": "ftp", "host": "127.0.0.1", "port": self.server_address[1], "user": "u", "password": "right", "tls": False}
